import random
from datetime import date, timedelta

from helpers import SMALL
from pyspark.sql import functions as F

from ledgerweave.functions import scalars
from ledgerweave.operators import fold, matching
from ledgerweave.operators import ledger as ops
from ledgerweave.streaming import landing


def naive(rows):
    """The same ladder over a plain list, scanned each time."""
    held, out = [], []
    for n in rows:
        hit, tier = None, "unresolved"
        by_id = [h for h in held if n["source_id"] and h["source"] == n["source"] and h["source_id"] == n["source_id"]]
        alike = [h for h in held if h["content_key"] == n["content_key"] and fold.may_be_one(n, h, True)]
        apart = lambda h: abs((n["value_date"] - h["value_date"]).days)
        near = [h for h in held if h["amount_minor"] == n["amount_minor"] and apart(h) <= fold.window_of(n, h) and fold.may_be_one(n, h, h["content_key"] == n["content_key"])]
        if by_id:
            hit, tier = by_id[0], "source_id"
        elif alike:
            hit, tier = alike[0], "content_key"
        elif near:
            hit, tier = min(near, key=lambda h: (apart(h), held.index(h))), "fuzzy"
        if hit is None:
            held.append({**n, "entity_id": fold.mint(n)})
            out.append((n["event_id"], held[-1]["entity_id"], tier))
        else:
            held[held.index(hit)] = {**n, "entity_id": hit["entity_id"]}
            out.append((n["event_id"], hit["entity_id"], tier))
    return out


def test_fold_equals_a_linear_scan():
    for seed in range(25):
        rng = random.Random(seed)
        rows = []
        for i in range(80):
            source, amount, day, text = rng.choice("abm"), rng.choice([100, 200, 300]), date(2024, 1, 1) + timedelta(rng.randint(0, 20)), rng.choice("xyz")
            tier = {"a": "authoritative", "b": "authoritative", "m": "manual"}[source]
            rows.append({"event_id": i, "account_id": "q", "source": source, "tier": tier, "source_id": f"i{rng.randint(0, 30)}" if source == "a" else None, "amount_minor": amount, "value_date": day, "status": rng.choice(["booked", "pending"]), "content_key": f"{amount}{day}{text}", "occurrence": rng.randint(0, 1), "arrival_seq": i, "description": text, "artefact_digest": "d"})
        assert [(e, x, t) for e, _, x, t, _ in fold.fold_account(rows)] == naive(rows)


def test_resolve_is_deterministic_and_whole(spark):
    keyed = ops.with_keys(ops.project_events(spark.read.parquet(f"{SMALL}/events.parquet")))
    once = {tuple(r) for r in fold.resolve(keyed).collect()}
    assert once == {tuple(r) for r in fold.resolve(keyed.repartition(7)).collect()} and len(once) == keyed.count()


def test_transfer_pairs_are_one_to_one(spark):
    ledger = ops.project_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    rows = {r.event_id: r for r in ledger.collect()}
    pairs = matching.transfer_pairs(ledger).collect()
    assert pairs and len({p.debit_event_id for p in pairs}) == len({p.credit_event_id for p in pairs}) == len(pairs)
    for p in pairs:
        a, b = rows[p.debit_event_id], rows[p.credit_event_id]
        assert a.amount_minor == -b.amount_minor < 0 and a.account_id != b.account_id and abs((a.value_date - b.value_date).days) <= 1


LEDGER = "event_id bigint, account_id string, source string, value_date date, amount_minor bigint, description string, arrival_seq bigint"


def movements(seed, n, accounts="abc", sources="xyz", amounts=(100, 200, -100, -200), span=25):
    rng = random.Random(seed)
    return [(k, rng.choice(accounts), rng.choice(sources), date(2024, 1, 1) + timedelta(rng.randint(0, span)), rng.choice(amounts), rng.choice(["p", "Q", " q"]), k) for k in range(n)]


def take_nearest(asks, offers, fits):
    """Greedy by brute force: asks in order, each with the nearest free offer; what stays alone on both sides and the pairs."""
    free, pairs, alone = list(enumerate(offers)), [], []
    for a in asks:
        near = [(g, j, o) for j, o in free if (g := fits(a, o)) is not None]
        if near:
            _, j, o = min(near, key=lambda x: (x[0], x[1]))
            free.remove((j, o))
            pairs.append((a, o))
        else:
            alone.append(a)
    return pairs, alone, [o for _, o in free]


def by_order(rows):
    return sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0]))


def test_leftovers_and_siblings_equal_brute_force(spark):
    rows = movements(5, 260)
    df = spark.createDataFrame(rows, LEDGER)
    gap = lambda a, b: abs((a[3] - b[3]).days)
    want, told = set(), {}
    for account in "abc":
        for left, right in (("x", "y"), ("x", "z"), ("y", "z")):
            mine, theirs = (by_order([r for r in rows if r[1] == account and r[2] == s]) for s in (left, right))
            _, a, b = take_nearest(mine, theirs, lambda p, q: gap(p, q) if p[4] == q[4] and gap(p, q) <= 2 else None)
            _, a, b = take_nearest(by_order(a), by_order(b), lambda p, q: gap(p, q) if (p[4], p[5].strip().lower()) == (q[4], q[5].strip().lower()) and gap(p, q) <= 7 else None)
            want |= {(account, left, right, r[0], r[2]) for r in a + b}
            for side, other, over in ((left, right, a), (right, left, b)):
                pool = by_order([r for r in rows if r[1] != account and r[2] == other])
                fits = lambda p, q: (gap(p, q), 0) if p[4] == q[4] and gap(p, q) <= 2 else (gap(p, q), 1) if p[4] == -q[4] and gap(p, q) <= 1 else None
                # Ties at equal distance and sign go by day, text and id, as in the operator.
                pool = sorted(pool, key=lambda r: (r[3], r[5], r[0]))
                pairs, _, _ = take_nearest(sorted(over, key=lambda r: (r[3], r[5], r[0])), pool, fits)
                told |= {(account, side, other, p[0]): q[0] for p, q in pairs}
    left_rows = matching.leftovers(df).checkpoint()
    assert {tuple(r) for r in left_rows.collect()} == want
    got = matching.sibling_attribution(df, left_rows).collect()
    assert {(r.account_id, r.source, r.other_source, r.event_id): r.sibling_event_id for r in got if r.sibling_event_id is not None} == told and len(got) == len(want)
    assert matching.leftovers(df.where("false")).count() == 0


def test_transfers_equal_a_plain_walk(spark):
    for seed in range(3):
        rows = movements(seed, 300, span=20)
        order = sorted(rows, key=lambda r: (r[3], r[1], r[6]))
        used, want = set(), set()
        for d in (r for r in order if r[4] < 0):
            hit = next((c for c in order if c[4] == -d[4] and c[0] not in used and c[1] != d[1] and abs((c[3] - d[3]).days) <= 1), None)
            if hit:
                used.add(hit[0])
                want.add((d[0], hit[0]))
        assert {tuple(r) for r in matching.transfer_pairs(spark.createDataFrame(rows, LEDGER)).collect()} == want


def test_rows_filed_elsewhere_raise_doubt(spark):
    d = date(2024, 1, 1)
    rows = [(k, "wrong", "file", d + timedelta(9 * k), 100 + k, "t", k) for k in range(6)] + [(100 + k, "right", "feed", d + timedelta(9 * k), 100 + k, "t", k) for k in range(5)] + [(200, "wrong", "feed", d, 7, "t", 0)]
    df = spark.createDataFrame(rows, LEDGER)
    got = [tuple(r) for r in matching.destination_doubt(df, matching.sibling_attribution(df, matching.leftovers(df))).collect()]
    assert got == [("wrong", "file", "feed", 6, 5, "right")]


def walked(monkeypatch):
    """The number of rows of each walk from here on."""
    sizes, whole = [], matching.in_order
    monkeypatch.setattr(matching, "in_order", lambda df, *rest: (sizes.append(df.count()), whole(df, *rest))[1])
    return sizes


def test_doubt_walks_numbers_of_a_crowded_amount(spark, monkeypatch):
    d = date(2024, 1, 1)
    rows = [(1000 * a + 100 * day + 10 * k + (s == "feed"), f"a{a:02}", s, d + timedelta(day), 500, "t", k) for a in range(20) for s in ("file", "feed") for day in range(3) for k in range(10)]
    rows += [(90000 + k, "wrong", "file", d + timedelta(k % 3), 500, "t", k) for k in range(12)] + [(91000, "wrong", "feed", d, 7, "t", 0)]
    df, sizes = spark.createDataFrame(rows, LEDGER), walked(monkeypatch)
    got = [tuple(r) for r in matching.destination_doubt(df, matching.sibling_attribution(df, matching.leftovers(df))).collect()]
    assert got == [("wrong", "file", "feed", 12, 12, "a00")]
    # Pairing walks a number for each account, side and day; siblings walk what can be reached of the offers of a day.
    assert sum(sizes) < len(rows) / 3


def test_all_accounts_read_the_same_offers(spark, monkeypatch):
    rows = [(*r[:5], [r[5], None][r[0] % 7 == 0], r[6]) for r in movements(11, 420, "abcdefghijkl", "xy", (100, -100, 0), 6)]
    df, placed = spark.createDataFrame(rows, LEDGER), {r[0]: r for r in rows}
    left, order = matching.leftovers(df).checkpoint(), lambda r: (r[3], r[5] is not None, r[5] or "", r[0])
    asks = [(r.account_id, r.side, "y" if r.side == "x" else "x", r.event_id) for r in left.collect()]
    fits = lambda p, q: (abs((p[3] - q[3]).days), p[4] != q[4]) if p[4] == q[4] and abs((p[3] - q[3]).days) <= 2 or p[4] == -q[4] and abs((p[3] - q[3]).days) <= 1 else None
    want = set()
    for account, side, other in {a[:3] for a in asks}:
        pool = sorted((r for r in rows if r[1] != account and r[2] == other), key=order)
        pairs, alone, _ = take_nearest(sorted((placed[a[3]] for a in asks if a[:3] == (account, side, other)), key=order), pool, fits)
        want |= {(account, side, other, p[0], q[0], q[1], p[4] != q[4]) for p, q in pairs} | {(account, side, other, p[0], None, None, None) for p in alone}
    sizes = walked(monkeypatch)
    assert {tuple(r) for r in matching.sibling_attribution(df, left).collect()} == want and len(want) == len(asks) > 50
    assert len({a[0] for a in asks}) > 9 and sum(sizes) <= len(rows) + len(asks)


def test_parts_of_an_account_fold_like_the_whole(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        source = rng.choice("abm")
        rows.append((i, "q", source, {"m": "manual"}.get(source, "authoritative"), f"i{rng.randint(0, 90)}" if source == "a" else None, rng.choice([100, 200, 300, 400, 500, 600, 700]), date(2024, 1, 1) + timedelta(rng.randint(0, 60)), rng.choice(["booked", "pending"]), i, rng.choice("xyz"), f"d{i // 9}"))
    df = spark.createDataFrame(rows, "event_id bigint, account_id string, source string, tier string, source_id string, amount_minor bigint, value_date date, status string, arrival_seq bigint, description string, artefact_digest string")
    keyed = ops.with_keys(df).checkpoint()
    whole = fold.fold_account([r.asDict() for r in sorted(keyed.collect(), key=lambda r: r.arrival_seq)])
    assert {tuple(r) for r in fold.resolve(keyed).collect()} == set(whole)


def test_amounts_parse_strictly(spark):
    cases = {"£1,234.50": 123450, "(2.00)": -200, "-3": -300, "1.005": None, "abc": None, "": None, "1.500": 150, ".50": 50, "(5.00)": -500, " £ 2": 200, "-.5": -50}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.parse_amount(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_streams_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/raw_artefacts.parquet")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = landing.artefact_stream(spark, str(tmp_path / "in"), rows, 1)
    landing.run_available(landing.land_once(stream), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == rows.select(F.sha2("payload", 256), "account_ref", "source").distinct().count()
    landing.run_available(landing.running_counts(stream), str(tmp_path / "counts"), str(tmp_path / "c2"), "complete")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert got == {tuple(r) for r in landing.running_counts(rows).collect()}
