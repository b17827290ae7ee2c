import json
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from helpers import SMALL, same
from pyspark.sql import functions as F

from ledgerweave.llm import byte_bpe, canonical, delivery_dedup, linkage, mixing, queries, reading_level
from ledgerweave.sources.artefacts import decode, read_records
from ledgerweave.sources.records import day_and_amount

RAW = "arrival_seq bigint, account_ref string, source string, fetched_at timestamp, payload binary, digest string"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def feed(records):
    return json.dumps({"results": [{"timestamp": f"{d}T00:00:00Z", "amount": a / 100, "transaction_id": random.random()} for d, a in records]}).encode()


def expected(rows, threshold=0.8):
    """Earliest earlier delivery with enough shared records, by comparing with all."""
    out, seen = set(), []
    for seq, account, source, at, payload, _ in sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[3] or datetime(1, 1, 1), r[0])):
        found = read_records(decode(payload))
        if not found or not found[1]:
            continue
        keys = Counter(day_and_amount(r) for r in found[1])
        for other, scope, held in seen:
            if scope == (account, source) and sum((held & keys).values()) >= threshold * max(sum(keys.values()), sum(held.values())):
                out.add((min(seq, other), max(seq, other)))
                break
        seen.append((seq, (account, source), keys))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_deliveries_equal_brute_force(spark, batches):
    rng, rows, t0 = random.Random(3), [], datetime(2024, 1, 1)
    base = [(date(2024, 1, 1) + timedelta(k), rng.randint(100, 999)) for k in range(400)]
    for seq in range(120):
        start, n = rng.choice([0, 10, 20, 30]) + rng.randint(0, 3), rng.choice([1, 2, 5, 9, 10, 20])
        records = [r if rng.random() > 0.06 else (r[0], 7) for r in base[start : start + n]]
        rng.shuffle(records)
        rows.append((seq, rng.choice(["a", "b", None]), rng.choice(["s", None]), rng.choice([None, t0 + timedelta(hours=rng.randint(0, 500))]), feed(records), "x"))
    rows += [(900 + k, "hot", "s", t0, feed(base[:50]), "x") for k in range(40)]  # one payload many times
    rows += [(990, "a", "s", t0, b"", "x"), (991, "a", "s", t0, None, "x"), (992, "a", "s", t0, b"{bad", "x"), (993, "a", "s", t0, b'{"results": []}', "x"), rows[3]]
    got = delivery_dedup.repeated_deliveries(spark.createDataFrame(rows, RAW), batches).collect()
    assert {tuple(r) for r in got} == expected(rows) and len(got) == len(expected(rows))


def store_files(folder):
    return {f for f in folder.rglob("*.parquet")}


@pytest.mark.parametrize("bucket_prints,fan", [(1 << 18, 8), (7, 2)])
def test_a_store_goes_on_where_it_was_left(spark, tmp_path, bucket_prints, fan):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    base = [(date(2024, 1, 1) + timedelta(k), rng.randint(100, 999)) for k in range(60)]
    rows = [(k, rng.choice(["a", "b"]), "s", t0 + timedelta(hours=k), feed(base[(a := rng.choice([0, 1, 20, 21])) : a + 20]), "x") for k in range(24)]
    path = f"file://{tmp_path}/store"
    pairs, held = set(), set()
    for low, high in ((0, 9), (9, 14), (14, 18), (18, 24)):
        store = delivery_dedup.FingerprintStore(spark, path, bucket_prints=bucket_prints, fan=fan)
        if low == 9:
            # What a batch left that never finished does not count and is in nobody's way.
            store.folder.write(spark.range(3).withColumn("bucket", F.lit(0)), "sets", "bucket")
            store = delivery_dedup.FingerprintStore(spark, path, bucket_prints=bucket_prints, fan=fan)
        pairs |= {(min(r), max(r)) for r in map(tuple, store.add(delivery_dedup.signatures(spark.createDataFrame(rows[low:high], RAW))).collect())}
        now = store_files(tmp_path / "store")
        assert held <= now
        held = now
    assert pairs == expected(rows) and len({b for _, b in pairs if b >= 9}) > 5
    last = delivery_dedup.FingerprintStore(spark, path)
    # One of the batches brings nothing new; of the other three two are merged at a fan of two.
    assert last.batches == 4 and len(last.segments) == (3 if fan == 8 else 2)


def test_a_batch_reads_only_the_buckets_it_may_share(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    many = [(k, f"a{k}", "s", t0 + timedelta(hours=k), feed([(date(2024, 1, 1) + timedelta(j), 100 * k + j) for j in range(10)]), "x") for k in range(60)]
    store = delivery_dedup.FingerprintStore(spark, f"file://{tmp_path}/s", bucket_prints=8)
    store.add(delivery_dedup.signatures(spark.createDataFrame(many, RAW)))
    (_, _, buckets), = store.segments
    one = delivery_dedup.signatures(spark.createDataFrame([(900, *many[5][1:3], t0 + timedelta(days=90), *many[5][4:])], RAW)).checkpoint()
    prints = one.select(F.explode("prints").alias("print"))
    read = store._positives(prints, prints.count()).select("bucket").distinct().count()
    assert buckets > 40 and 0 < read <= prints.count() + 2
    assert [tuple(r) for r in store.add(one).collect()] == [(900, 5)]


def test_no_deliveries(spark):
    assert delivery_dedup.repeated_deliveries(spark.createDataFrame([], RAW)).count() == 0


def test_winnowing_keeps_a_common_print_at_the_threshold():
    rng = random.Random(1)
    for n in range(1, 60):
        for _ in range(40):
            most = n // 5
            a = rng.sample(range(10**6), n)
            gone = rng.sample(range(n), rng.randint(0, most))
            b = sorted([x for i, x in enumerate(a) if i not in gone] + rng.sample(range(10**6, 10**7), min(len(gone), most)) )
            a = sorted(a)
            shared = len(set(a) & set(b))
            if shared >= 0.8 * max(len(a), len(b)):
                assert set(delivery_dedup.winnow(a)) & set(delivery_dedup.winnow(b))


def test_encoding_equals_the_public_library():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(byte_bpe.vocabulary_path())
    known.encode_special_tokens = True
    mine = byte_bpe.Encoder(byte_bpe.Merges.load(byte_bpe.vocabulary_path()))
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|> x", "a" * 3000, "ab" * 700, " " * 900, "é🙂‍\x00\x1c\x85", "don't DON'T 12345678 --==--"]
    texts += ["".join(rng.choice("abcdethr nsi-=é🙂0\n'") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    for text in texts:
        ids = list(mine.encode(text))
        assert ids == known.encode(text, add_special_tokens=False).ids and mine.count(text) == len(ids)
        state = byte_bpe.Decoder(mine.merges)
        assert "".join(state.push([i]) for i in ids) + state.close() == text


def test_encoding_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hi", 5), (3, "hi", 5)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in byte_bpe.encode_texts(df).collect()]
    assert sorted(got)[:2] == [(1, []), (2, [])] and len(got) == 4
    assert byte_bpe.encode_texts(df.where("doc_id < 0")).count() == 0


def test_canonical_merchants(spark):
    entries = spark.createDataFrame([(1, "Jiffor Parking Co", "parking", "T"), (2, "Jiffor Florist", "florist", "T"), (3, "The Waiskum Bakery", "bakery", "T"), (4, "Laskane & Sons Insurance", "insurance", "T")], "merchant_id bigint, merchant string, sector string, town string")
    cases = {
        1: ("jiffor parkng", None, 1), 2: ("JIFFÖR FLORIST LTD", "x", 2), 3: (None, "CARD PAYMENT TO WAISKUM BAKE", 3), 4: ("???", "PQ *LASKANEINSCE", 4), 5: ("La5kan3 Insurance", None, 4), 6: ("Wosten Books", "PQ *LASKANEINSCE", 0),
        7: (None, None, 0), 8: ("", "REF 88372", 0), 9: ("Jiffor", "DD JIFFOR FLRST REF 7", 2), 10: ("Jiffor", None, 0), 11: ("Jiffor Bakery", None, 0), 12: ("Bakery, Waiskum", None, 3), 13: ("wais kum bakery", "x" * 5000, 3),
    }
    events = spark.createDataFrame([(k, m, d, "e") for k, (m, d, _) in cases.items()] + [(1, "jiffor parkng", None, "e")], "event_id bigint, merchant string, description string, extra string")
    groups = spark.createDataFrame([(1, "jiffor prkg 88"), (2, None)], "group_id bigint, example string")
    got = {(r.row_kind, r.row_key): r.merchant_id for r in canonical.meant_merchants(events, groups, entries).collect()}
    assert got == {("event", k): v for k, (_, _, v) in cases.items()} | {("group", 1): 1, ("group", 2): 0}
    none = canonical.meant_merchants(events, groups, entries.where("merchant_id < 0")).collect()
    assert len(none) == len(got) and all(r.merchant_id == 0 for r in none)


def test_tokens_combine_in_any_order_and_number(spark):
    entries = spark.createDataFrame([(1, "BP", "fuel", "T"), (2, "Harbour Light Bakery", "bakery", "T"), (3, "Old Harbour Books", "books", "U")], "merchant_id bigint, merchant string, sector string, town string")
    cases = {1: ("BP", 1), 2: ("Harbour Bakery", 2), 3: ("Light Harbour Bakery", 2), 4: ("bp fuel T", 1), 5: ("Harbour", 0), 6: ("HARBUOR LIGTH BAKERY", 2), 7: ("oldharbourbooks", 3), 8: ("0ld Harb0ur B00ks", 3), 9: ("New Quay Books", 0), 10: ("Har bour Light Bkry", 2), 11: ("???", 0)}
    events = spark.createDataFrame([(k, m, None) for k, (m, _) in cases.items()], "event_id bigint, merchant string, description string")
    got = {r.row_key: r.merchant_id for r in canonical.meant_merchants(events, spark.createDataFrame([], "group_id bigint, example string"), entries).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_long_words_are_repaired_like_short_ones(spark):
    rng, letters = random.Random(6), "abcdefghij"
    forms = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 60))) for _ in range(60)]
    words = []
    for form in forms:
        for _ in range(6):
            w = list(form)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            words.append("".join(w) or "x")
    words += ["y" * 5000, "abc"]

    def edits(a, b):
        old = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
            old = new
        return old[-1]

    want = {(w, f) for w in set(words) for f in set(forms) if 3 <= len(w) and abs(len(w) - len(f)) <= 2 and edits(w, f) <= (1 if len(f) < 6 else 2)}
    found = canonical.repairs(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(f,) for f in forms], "form string"), max(map(len, forms)))
    got = {(r.token, r.form) for r in found.collect()}
    assert want <= got and all(sorted(w) == sorted(f) for w, f in got - want)


def test_values_beside_many_entries_are_placeholders(spark):
    names = ["Zarnwell Books", "Plunkett Dental", "Moorish Energy", "Quoskane Media"]
    entries = spark.createDataFrame([(k, n, n.split()[1].lower(), "T") for k, n in enumerate(names, 1)], "merchant_id bigint, merchant string, sector string, town string")
    rows = [(k, "see slip", n.upper()) for k, n in enumerate(names, 1)] + [(10, "Wosten", names[0]), (11, "unknown", names[1]), (12, None, names[2])]
    got = {r.row_key: r.merchant_id for r in canonical.meant_merchants(spark.createDataFrame(rows, "event_id bigint, merchant string, description string"), spark.createDataFrame([], "group_id bigint, example string"), entries).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 10: 0, 11: 2, 12: 3}


def household(spark):
    rng, lines, payments, truth = random.Random(9), [], [], set()
    names = ["Zarnwell Books", "Plunkett Dental", "Moorish Energy", "Quoskane Media", "Tholman Garage", "Vexley Wines"]
    for k in range(240):
        account, name, amount, day = rng.choice(["a1", "a2"]), rng.choice(names), rng.randint(300, 30000), date(2024, 1, 1) + timedelta(rng.randint(0, 300))
        status = "booked" if k % 9 else "pending"
        payments.append((f"e{k}", account, -amount, day, day + timedelta(rng.randint(0, 2)), name, name, status))
        if status == "booked" and k % 4:
            sign = 1 if account == "a2" else -1
            label = "Plain Current 1234" if account == "a1" else "GOLD CARD ****9876"
            shown = payments[-1][4] if k % 13 else None
            lines.append((k, f"s-{account}-{day.month}", label if k % 3 else None, 1, day.day, shown, name.upper(), sign * (amount if k % 17 else round(amount * 1.02))))
            truth.add((k, f"e{k}"))
    schema_l = "row_id bigint, statement_id string, account_name string, page_no int, line_no int, value_date date, description string, amount_minor bigint"
    schema_p = "entity_id string, account_id string, amount_minor bigint, value_date date, booking_date date, description string, counterparty string, status string"
    accounts = spark.createDataFrame([("a1", "Plain Current 1234"), ("a2", "Gold Card 9876")], "account_id string, label string")
    lines += [(900, None, None, None, None, None, None, None), (901, "s-a1-1", None, 1, 0, None, "BALANCE BROUGHT FORWARD", 123456789), lines[0]]
    payments += [(None, None, None, None, None, None, None, None), payments[0]]
    return spark.createDataFrame(lines, schema_l), spark.createDataFrame(payments, schema_p), accounts, truth


def test_linkage_finds_the_planted_pairs(spark):
    lines, payments, accounts, truth = household(spark)
    got = linkage.link(lines, payments, accounts).collect()
    pairs = {(r.row_id, r.entity_id) for r in got}
    assert len({r.row_id for r in got}) == len({r.entity_id for r in got}) == len(got) and all(0.5 <= r.confidence <= 1 for r in got)
    assert len(pairs & truth) >= 0.93 * len(truth) and len(pairs & truth) >= 0.95 * len(pairs)


def test_one_line_places_a_statement_without_a_name(spark):
    d = date
    lines = spark.createDataFrame(
        [(1, "s1", d(2023, 10, 17), "REEVOVA BKS ROSTANE", -658), (2, "s1", d(2023, 10, 1), "BROUGHT FORWARD", 90000), (3, "s2", d(2023, 10, 17), "ZARN MEDIA", -700), (4, "s3", d(2023, 10, 17), "QUIBBLE GARAGE", -900), (5, "s4", d(2023, 10, 17), "PLUNK DENTAL", -800)],
        "row_id bigint, statement_id string, value_date date, description string, amount bigint",
    )
    payments = spark.createDataFrame(
        [("e1", "a1", -658, "Reevova Books Co"), ("e2", "a2", -658, "Wirnen Upholstery"), ("e3", "a1", -700, "Zarn Media"), ("e4", "a2", -700, "Zarn Media"), ("e5", "a2", -900, "Other Words"), ("e6", "a2", -800, "Plunk Dental"), ("e6", "a2", -800, "Plunk Dental")],
        "entity_id string, account_id string, t_amount bigint, description string",
    ).selectExpr("*", "DATE '2023-10-18' AS booked", "CAST(NULL AS string) AS counterparty")
    got = {tuple(r) for r in linkage.met_accounts(lines, payments).collect()}
    assert got == {("s1", "a1"), ("s4", "a2")}


def test_statements_find_their_account_by_digits_letters_and_amounts(spark):
    d = date
    rows = spark.createDataFrame(
        [(1, "s1", "Plain a/c 1234", d(2024, 1, 5), -700), (2, "s1", "Plain a/c 1234", d(2024, 1, 9), -800), (3, "s2", "Holiday Pot", d(2024, 1, 9), -1), (4, "s3", "Other 9999", d(2024, 1, 9), -1), (5, "s4", None, None, -1)],
        "row_id bigint, statement_id string, account_name string, value_date date, amount bigint",
    )
    accounts = spark.createDataFrame([("a1", "Plain Current 1234"), ("a2", "Plain Saver 1234"), ("a3", "HOLIDAY POT"), ("a4", "Quite Different 9999")], "account_id string, label string")
    payments = spark.createDataFrame([("a1", -700, d(2024, 1, 5)), ("a1", -800, d(2024, 1, 10)), ("a2", -700, d(2024, 1, 5))], "account_id string, t_amount bigint, booked date")
    assert {tuple(r) for r in linkage.printed_accounts(rows, accounts, payments).collect()} == {("s1", "a1"), ("s2", "a3")}


def test_linkage_of_empty_tables(spark):
    lines, payments, accounts, _ = household(spark)
    assert linkage.link(lines.where("row_id < 0"), payments, accounts).count() == 0
    assert linkage.link(lines, payments.where("entity_id = 'none'"), accounts).count() == 0


def test_mixture_keeps_caps_and_meets_targets(spark):
    rng = random.Random(4)
    sizes = [(k, rng.choice(["big", "big", "big", "small", None, "other"]), rng.randint(0, 300)) for k in range(4000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.4, 3), ("empty", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    held = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint")
    allotted = mixing.allotments(held, targets)
    taken = mixing.mix(held, allotted)
    rows = taken.collect()
    caps, of = {"big": 1, "small": 3}, {k: (s, n) for k, s, n in sizes}
    assert len({r.doc_id for r in rows}) == len(rows) and all(of[r.doc_id] == (r.source, r.n_tokens) and 1 <= r.copies <= caps[r.source] for r in rows)
    total = sum(r.copies * r.n_tokens for r in rows)
    share = sum(r.copies * r.n_tokens for r in rows if r.source == "big") / total
    assert abs(share - 5 / 9) < 0.01
    # Brute force: walk each source in the operator's order and count the integers that the prefix sum crosses.
    each = {r.source: r for r in allotted.collect()}
    for source in caps:
        want = each[source].allotted / each[source].tokens * sum(1 for _, s, n in sizes if s == source and n > 0)
        assert abs(sum(r.copies for r in rows if r.source == source) - want) <= 1
    capped = {r.source: r for r in mixing.allotments(held, targets, total=10**9).collect()}
    assert all(capped[s].copies_each == caps[s] for s in caps)
    assert mixing.mix(held.where("false"), mixing.allotments(held.where("false"), targets)).count() == 0


def test_reading_levels_on_held_out_grades(spark):
    graded = spark.read.parquet(f"{SMALL}/graded_texts.parquet")
    held = graded.where("sample_id % 3 = 0")
    docs = held.selectExpr("sample_id AS doc_id", "text", "band AS level").union(spark.createDataFrame([(-1, None, 0), (-2, "", 0), (-3, " \n ", 0), (-4, "17 Feb  XXQ 251.71  5243.67\n" * 50, 0), (-5, "{\"a\": [1, 2]}", 0)], "doc_id bigint, text string, level int"))
    got = {r.doc_id: r for r in reading_level.reading_levels(docs, graded.where("sample_id % 3 <> 0")).collect()}
    assert len(got) == docs.count() and all(got[-k].level is None and got[-k].hard_share == 0 for k in range(1, 6))
    errors = [abs(got[r.sample_id].level - r.band) for r in held.collect()]
    right = [(got[r.sample_id].hard_share > 0.5) == (r.band >= 4) for r in held.collect()]
    assert sum(errors) / len(errors) < 0.5 and all(right)
    assert all(r.level is None for r in reading_level.reading_levels(docs, graded.where("false")).collect())


def test_ordinary_english_of_other_words_is_prose(spark):
    graded = spark.read.parquet(f"{SMALL}/graded_texts.parquet")
    plain = "When the gardener had walked across the meadow, he saw that none of the roses which she had planted were in bloom, and so he went back to the house for a while. It was not what they had hoped for, but there was nothing that anyone could do about it."
    german = "Der Gaertner ging ueber die Wiese und sah, dass keine der Rosen bluehte, die sie im Herbst gepflanzt hatte, also kehrte er nach Hause zurueck."
    docs = spark.createDataFrame([(1, plain), (2, german), (3, "date;amount;currency;balance\n" * 20), (4, "{\"amount\": {\"currency\": \"GBP\"}, \"status\": \"SETTLED\"}")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in reading_level.reading_levels(docs, graded).collect()}
    assert got[1].prose_share > 0.9 and got[1].level is not None and all(got[k].prose_share == 0 for k in (2, 3, 4))


def test_propagation_stops_where_it_has_settled(spark):
    graded, docs = spark.read.parquet(f"{SMALL}/graded_texts.parquet"), spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 7 = 0")
    soon, late = ({r.doc_id: r for r in reading_level.reading_levels(docs, graded, tolerance=t).collect()} for t in (reading_level.TOLERANCE, reading_level.TOLERANCE / 20))
    assert all((a.level is None) == (late[k].level is None) and (a.level is None or abs(a.level - late[k].level) < 0.1) for k, a in soon.items())
