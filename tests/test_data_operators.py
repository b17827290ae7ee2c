import gzip
import json
import random
from datetime import date, datetime, timedelta

from ledgerweave.operators import drift, history, intervals, nested

OBS = "observation_id bigint, account_id string, fact string, kind string, observed_at date, value string, window_from date, window_to date, provenance string, ingested_at timestamp, note string"
EXT = "account_id string, probed_back_to date, note string"
RAW = "arrival_seq bigint, source string, media_type string, fetched_at timestamp, payload binary, note string"
SCH = "source string, field_name string, field_type string, optional boolean, field_no int"


def test_gaps_equal_a_day_by_day_count(spark):
    rng, day0, rows, want = random.Random(5), date(2024, 1, 1), [], set()
    for series in range(12):
        held = set()
        for _ in range(rng.randint(1, 9)):
            a, n = rng.randint(0, 120), rng.randint(-2, 15)
            rows.append((1, f"a{series}", "coverage", "k", None, None, day0 + timedelta(a), day0 + timedelta(a + n), None, None, "x"))
            held |= set(range(a, a + n + 1))
        days = sorted(held)
        want |= {(f"a{series}", str(day0 + timedelta(x + 1)), str(day0 + timedelta(y - 1))) for x, y in zip(days, days[1:]) if y > x + 1}
    df = spark.createDataFrame(rows + rows[:5], OBS)
    got = intervals.coverage_gaps(df, spark.createDataFrame([], EXT)).collect()
    assert {(r.account_id, r.gap_from, r.gap_to) for r in got} == want and len(got) == len(want)


def test_open_windows_null_keys_and_probes(spark):
    d = date
    rows = [
        (1, "a", "coverage", None, None, None, None, d(2024, 1, 5), None, None, ""), (2, "a", "coverage", None, None, None, d(2024, 1, 9), None, None, None, ""),
        (3, "b", "coverage", "k", None, None, d(2024, 2, 1), d(2024, 2, 2), None, None, ""), (4, "b", "promo_rate", "k", None, None, d(2024, 2, 1), d(2024, 2, 2), None, None, ""),
        (5, "c", "coverage", "k", None, None, d(2024, 2, 9), d(2024, 2, 1), None, None, ""),
    ]
    probes = spark.createDataFrame([("a", d(2020, 1, 1), ""), ("b", d(2024, 1, 30), ""), ("b", None, ""), (None, d(2000, 1, 1), "")], EXT)
    got = {tuple(r) for r in intervals.coverage_gaps(spark.createDataFrame(rows, OBS), probes).collect()}
    assert got == {("a", "coverage", None, "2024-01-06", "2024-01-08"), ("b", "coverage", "k", "2024-01-30", "2024-01-31")}
    assert intervals.coverage_gaps(spark.createDataFrame([], OBS), probes).count() == 0


def test_versions_of_a_fact(spark):
    d, t = date, datetime(2024, 1, 1)
    rows = [
        (1, "a", "rate", "", d(2024, 1, 1), "6.5 %", None, None, "statement", t, ""), (2, "a", "rate", "", d(2024, 2, 1), "6.50% p.a.", None, None, "rule:x", t, ""),
        (3, "a", "rate", "", d(2024, 3, 1), "7", None, d(2024, 3, 31), "statement", t, ""), (4, "a", "rate", "", d(2024, 3, 1), "8", None, None, "human", t, ""),
        (5, "a", "rate", "", d(2024, 6, 1), " - ", None, None, "human", t, ""), (6, "a", "rate", "", None, "9", None, None, "human", t, ""),
        (7, "a", "name", "", d(2024, 1, 1), "Big  Saver", None, d(2024, 1, 10), None, t, ""), (8, "a", "name", "", d(2024, 2, 1), "BIG SAVER", None, None, None, t, ""),
    ]
    got = {tuple(r)[1:] for r in history.versions(history.readings(spark.createDataFrame(rows + rows[:2], OBS))).collect()}
    assert got == {("rate", "", "2024-01-01", "2024-02-29"), ("rate", "", "2024-03-01", ""), ("name", "", "2024-01-01", "2024-01-10"), ("name", "", "2024-02-01", "")}
    assert history.versions(history.readings(spark.createDataFrame([], OBS))).count() == 0


def test_ledger_supersedes_without_overwriting(spark):
    d = date
    rows = [
        (1, "a", "rate", "", d(2024, 1, 1), "5", None, None, "statement", datetime(2024, 1, 2), ""), (2, "a", "rate", "", d(2024, 1, 1), "6", None, None, "human", datetime(2024, 3, 1), ""),
        (3, "a", "rate", "", d(2024, 2, 1), "7", None, None, "statement", datetime(2024, 2, 2), ""),
    ]
    got = {r.observation_id: r for r in history.bitemporal_ledger(history.readings(spark.createDataFrame(rows, OBS))).collect()}
    assert got[1].recorded_to == datetime(2024, 3, 1) and got[2].recorded_to is None and got[2].valid_to == d(2024, 1, 31)


def test_late_readings_split_the_earlier_slice(spark):
    d, t = date, datetime
    rows = [(1, "a", "rate", "", d(2024, 1, 1), "5", None, None, "statement", t(2024, 1, 2), ""), (2, "a", "rate", "", d(2024, 2, 1), "6", None, d(2024, 5, 1), "statement", t(2024, 3, 10), "")]
    got = {tuple(r)[6:] + (r.plain,) for r in history.bitemporal_ledger(history.readings(spark.createDataFrame(rows, OBS))).select("account_id", "fact", "kind", "observation_id", "plain", "window_to", "valid_from", "valid_to", "recorded_from", "recorded_to").collect()}
    five, six = "5.000000", "6.000000"
    assert got == {(d(2024, 1, 1), None, t(2024, 1, 2), t(2024, 3, 10), five), (d(2024, 1, 1), d(2024, 1, 31), t(2024, 3, 10), None, five), (d(2024, 2, 1), d(2024, 5, 1), t(2024, 3, 10), None, six)}


def test_ledger_holds_the_belief_of_every_instant(spark):
    rng, day0, t0, rows = random.Random(3), date(2024, 1, 1), datetime(2024, 1, 1), []
    ranks = ("statement", "model:x", "human")
    for n in range(240):
        start = rng.randint(0, 25)
        window = rng.choice([None, None, rng.randint(0, 30)])
        at = rng.choice([None, *range(30)]) if n % 9 == 0 else rng.randint(0, 29)
        rows.append((n, f"a{n % 8}" if n % 8 else None, "rate", None, day0 + timedelta(rng.randint(0, 9)), str(n % 5), day0 + timedelta(start), None if window is None else day0 + timedelta(window), rng.choice(ranks), None if at is None else t0 + timedelta(at), ""))
    ledger = history.bitemporal_ledger(history.readings(spark.createDataFrame(rows + rows[:9], OBS))).collect()
    ends = {}
    for r in ledger:
        ends.setdefault((r.observation_id, r.recorded_from), []).append(r)
    assert all(len(x) == 1 for x in ends.values())
    for account in {r[1] for r in rows}:
        for instant in [None, *(t0 + timedelta(k) for k in range(31))]:
            known = [r for r in rows if r[1] == account and (r[9] is None or (instant is not None and r[9] <= instant))]
            best = {}
            for r in known:
                best[r[6]] = max(best.get(r[6], ((-1,),)), ((ranks.index(r[8]), r[4], r[0]), r))
            seen = [r for r in ledger if r.account_id == account and (r.recorded_from is None or (instant is not None and r.recorded_from <= instant)) and (r.recorded_to is None or (instant is None or instant < r.recorded_to))]
            assert len(seen) == len(best)
            for k in range(32):
                day = day0 + timedelta(k)
                starts = [s for s in best if s <= day]
                want = best[max(starts)][1] if starts else None
                want = [] if want is None or (want[7] is not None and want[7] < day) else [want[0]]
                assert [r.observation_id for r in seen if r.valid_from <= day and (r.valid_to is None or day <= r.valid_to)] == want


def test_versions_come_from_the_open_slice(spark, monkeypatch):
    d, t = date, datetime
    rows = spark.createDataFrame([(1, "a", "rate", "", d(2024, 1, 1), "5", None, None, "statement", t(2024, 1, 2), ""), (2, "a", "rate", "", d(2024, 2, 1), "6", None, d(2024, 5, 1), "statement", t(2024, 3, 10), "")], OBS)
    whole = history.bitemporal_ledger
    got = {tuple(r)[3:] for r in history.versions(history.readings(rows)).collect()}
    assert got == {("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-05-01")}
    monkeypatch.setattr(history, "bitemporal_ledger", lambda rows: whole(rows).where("plain = '5.000000'"))
    assert {tuple(r)[3:] for r in history.versions(history.readings(rows)).collect()} == {("2024-01-01", "2024-01-31")}


def held(value):
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def walk(value, path, anchor, listed, out):
    if isinstance(value, dict):
        for k, v in value.items():
            v = held(v)
            walk([v] if isinstance(v, dict) and k in listed else v, f"{path}.{k}" if path else k, anchor, listed, out)
    elif isinstance(value, list):
        for i, v in enumerate(map(held, value)):
            here = f"{path}[{i}]"
            if isinstance(v, dict):
                out.add((here, anchor))
            walk(v, here, here if isinstance(v, dict) else anchor, listed, out)


def test_nested_rows_equal_a_recursive_walk(spark):
    deep = {"x": 1}
    for _ in range(30):
        deep = {"a": [deep, 3]}
    docs = [
        {"results": [{"meta": {"legs": [{"n": 1, "notes": {"b": 2}}, None, 5]}}, "{\"z\": [{}]}", [{"q": 1}]]}, {"legs": {"k": [[{}]]}, "é.x": [{"a": []}]}, {}, deep,
        {"results": '[{"s": "not {json"}]', "text": "[draft] {note"},
    ]
    rows = [(i, "s", None, None, body, "") for i, d in enumerate(docs) for body in [json.dumps(d).encode()]]
    rows += [(90, "s", "x", None, gzip.compress(json.dumps(docs[0]).encode()), ""), (91, "s", None, None, json.dumps(docs[0]).encode("utf-16"), ""), (92, "s", None, None, b'{"a": [{}', ""), (93, "s", None, None, b"", ""), (94, None, None, None, None, ""), (95, "s", None, None, b"[{}]", "")]
    schemas = spark.createDataFrame([("s", "meta.legs", "array of objects", True, 1), ("s", "meta.legs.notes", "array of objects", True, 2)], SCH)
    want = set()
    for i, d in [*enumerate(docs), (90, docs[0]), (91, docs[0])]:
        out = set()
        walk(d, "", "", {"legs", "notes"}, out)
        want |= {(i, *x) for x in out}
    got = nested.nested_rows(spark.createDataFrame(rows, RAW), schemas).select("arrival_seq", "node_path", "parent_path").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert nested.nested_rows(spark.createDataFrame([], RAW), schemas).count() == 0


def test_single_objects_under_array_names_are_walked_to_the_end(spark):
    lone = {"feedItems": [{"attachments": {"pages": {"lines": {"x": 1}}}}]}
    shut = {"feedItems": [{"note": "]]]]}}}}", "attachments": [{"pages": [{"lines": [{"x": {"y": [{}]}}]}]}]}]}
    names = ("attachments", "attachments.pages", "attachments.pages.lines")
    schemas = spark.createDataFrame([("s", n, "array of objects", True, k) for k, n in enumerate(names)], SCH)
    for doc in (lone, shut):
        want = set()
        walk(doc, "", "", {n.rpartition(".")[2] for n in names}, want)
        rows = spark.createDataFrame([(1, "s", None, None, json.dumps(doc).encode(), "")], RAW)
        assert {(r.node_path, r.parent_path) for r in nested.nested_rows(rows, schemas).collect()} == want


def test_schema_changes(spark):
    schemas = spark.createDataFrame(
        [("c", "Date", "date dd/mm/yyyy", False, 1), ("c", "Name", "text", False, 2), ("c", "Amount", "decimal, 2 places", False, 3), ("c", "Note", "text", True, 4), ("j", "id", "string", False, 1), ("j", "amount", "object", False, 2), ("j", "amount.minor", "integer", False, 3), ("j", "legs", "array of objects", True, 4)], SCH
    )
    plain = b"date , NAME,Amount\n01/02/2024,x,1.00\n02/02/2024,y,2.50\n"
    renamed = b"Date;Payee;Amount;Extra\n2024-02-01;x;1.00;\n2024-02-02;y;2;\n"
    rows = [(1, "c", None, None, plain, ""), *[(k, "c", None, None, renamed, "") for k in (2, 3, 4)], (5, "c", None, None, b"Date,Name,Amount\n", ""), (6, "c", None, None, b"<html>", ""), (7, "c", None, None, None, "")]
    rows += [(8, "j", None, None, json.dumps({"results": [{"id": 5, "amount": {"minor": 3}, "legs": {"x": 1}}]}).encode(), ""), (9, "j", None, None, json.dumps({"pages": [{"results": [{"id": "a", "amount": json.dumps({"minor": "3"})}]}]}).encode(), "")]
    got = {tuple(r) for r in drift.schema_changes(spark.createDataFrame(rows, RAW), schemas).collect()}
    want = {(k, n, c) for k in (2, 3, 4) for n, c in (("Name", "renamed"), ("Extra", "added"), ("Date", "retyped"))} | {(8, "id", "retyped"), (9, "amount.minor", "retyped")}
    assert got == want
    table = {(r.arrival_seq, r.record_no): r for r in drift.consistent_records(spark.createDataFrame(rows, RAW), schemas).collect()}
    assert table[1, 0].amount_minor == 100 and table[2, 1].value_date == date(2024, 2, 2) and table[2, 0].counterparty == "x"
    assert drift.schema_changes(spark.createDataFrame([], RAW), schemas).count() == 0


def test_records_are_renamed_then_defaulted_then_cast(spark):
    schemas = spark.createDataFrame(
        [("c", "Date", "date dd/mm/yyyy", False, 1), ("c", "Name", "text", False, 2), ("c", "Amount", "decimal, 2 places", False, 3), ("c", "Currency", "text", False, 4), ("c", "Note", "text", True, 5), ("j", "id", "string", False, 1), ("j", "at", "iso timestamp", False, 2), ("j", "amount", "number", False, 3), ("j", "n", "integer", False, 4), ("j", "legs", "array of objects", True, 5), ("j", "legs.x", "integer", False, 6)], SCH
    )
    rows = [(1, "c", None, None, b"Date,Name,Amount,Currency\n01/02/2024,x,1.00,GBP\n", ""), (2, "c", None, None, b"Date,Beneficiary,Amount\n2024-02-01,y,EUR 1234.50\n2024-02-02,z,bad\n", "")]
    rows += [(3, "j", None, None, json.dumps({"results": [{"id": 7, "at": 1763100000, "amount": "11.99 GBP", "legs": {"x": 1}}]}).encode(), "")]
    renames = spark.createDataFrame([("c", "Name", "Payee"), ("c", "Payee", "Beneficiary")], "source string, old_name string, new_name string")
    got = {(r.arrival_seq, r.record_no): r for r in drift.consistent_records(spark.createDataFrame(rows, RAW), schemas, renames).collect()}
    assert got[1, 0].fields == {"Date": "01/02/2024", "Name": "x", "Amount": "1.00", "Currency": "GBP", "Note": None} and got[1, 0].steps == []
    assert json.loads(got[2, 0].typed) == {"Date": "01/02/2024", "Name": "y", "Amount": 1234.5, "Currency": "EUR", "Note": None}
    assert got[2, 0].steps == ["rename Beneficiary to Name", "default Currency", "cast Date to date dd/mm/yyyy", "cast Amount to decimal, 2 places"]
    assert got[2, 0].delivered == {"Date": "2024-02-01", "Amount": "EUR 1234.50"} and got[2, 0].currency == "EUR" and got[2, 0].amount_minor == 123450
    assert got[2, 1].fields["Amount"] is None and got[2, 1].delivered["Amount"] == "bad" and "unread Amount" in got[2, 1].steps
    assert got[1, 0].version != got[2, 0].version
    assert json.loads(got[3, 0].typed) == {"id": "7", "at": "2025-11-14T06:00:00Z", "amount": 11.99, "n": None, "legs": [{"x": 1}]}


def csv_file(header, *rows):
    return "\n".join([header, *rows]).encode()


def registry_tables(spark):
    schemas = spark.createDataFrame([("f", "Date", "date dd/mm/yyyy", False, 1), ("f", "Name", "text", False, 2), ("f", "Amount", "decimal, 2 places", False, 3)], SCH)
    t = datetime(2024, 1, 1)
    make = lambda seq, header, row: (seq, "f", "text/csv", t + timedelta(seq), csv_file(header, row, row), "x")
    first = [make(k, "Date,Merchant,Amount", "01/02/2024,a,1.00") for k in range(5)] + [make(k, "Date,Name,Amount", "01/02/2024,a,1.00") for k in range(5, 9)]
    # Later files keep both names, which speaks against the rename that earlier ones bore out.
    later = [make(k, "Date,Name,Merchant,Amount", "01/02/2024,a,b,1.00") for k in range(20, 60)] + [make(60, "Date, Extra ,Merchant,Amount", "01/02/2024,e,a,100")]
    return schemas, first, later


def test_a_registry_keeps_old_answers(spark, tmp_path):
    schemas, first, later = registry_tables(spark)
    path = f"file://{tmp_path}/registry"
    rows = lambda *parts: spark.createDataFrame(sum(parts, []), RAW)
    old = {tuple(r) for r in drift.schema_changes(rows(first), schemas, path=path).collect()}
    assert old == {(k, "Name", "renamed") for k in range(5)}
    registry = drift.SchemaRegistry(spark, path)
    before = {tuple(r) for r in registry.versions().select("version", "fingerprint").collect()}
    again = {tuple(r) for r in drift.schema_changes(rows(first, later), schemas, path=path).collect()}
    assert {r for r in again if r[0] < 20} == old
    assert {r for r in again if r[0] == 60} == {(60, "Name", "renamed"), (60, " Extra ", "added"), (60, "Amount", "retyped")} and (20, "Merchant", "added") in again
    after = {tuple(r) for r in drift.SchemaRegistry(spark, path).versions().select("version", "fingerprint").collect()}
    assert before < after and len({v for v, _ in after}) == len(after)
    steps = {(r.version, r.kind, r.field_name, r.new_name) for r in drift.migration_steps(drift.SchemaRegistry(spark, path).versions()).collect()}
    assert {(k, f, n) for _, k, f, n in steps} == {("rename", "Name", "merchant"), ("cast", "Amount", None)}


def test_chained_renames_and_doubled_headers(spark):
    schemas, _, _ = registry_tables(spark)
    rows = [(1, "f", None, datetime(2024, 1, 1), csv_file("Date,Shop,Amount", "01/02/2024,a,1.00"), "x"), (2, "f", None, None, csv_file("Date,DATE,Name,Amount", "01/02/2024,02/02/2024,b,2.00"), "x")]
    renames = spark.createDataFrame([("f", "Name", "merchant"), ("f", "merchant", "shop")], "source string, old_name string, new_name string")
    df = spark.createDataFrame(rows, RAW)
    assert {tuple(r) for r in drift.schema_changes(df, schemas, renames).collect()} == {(1, "Name", "renamed")}
    got = {r.arrival_seq: r for r in drift.consistent_records(df, schemas, renames).collect()}
    assert got[1].fields["Name"] == "a" and got[1].amount_minor == 100 and got[2].fields["Date"] == "01/02/2024" and got[2].fields["Name"] == "b"


def test_depth_is_the_documents_own(spark):
    schemas = spark.createDataFrame([("s", "a", "array of objects", True, 1), ("s", "a.b", "array of objects", True, 2), ("s", "a.b.c", "array of objects", True, 3), ("s", "a.x", "string", True, 4), ("s", "a.b.n", "integer", True, 5)], SCH)
    t = datetime(2024, 1, 1)
    one = lambda doc: {r.node_path for r in nested.nested_rows(spark.createDataFrame([(1, "s", None, t, json.dumps(doc).encode(), "x")], RAW), schemas).collect()}
    assert one({"note": "]]]]]]]]", "a": [{"b": [{"c": [{"d": 1}]}]}]}) == {"a[0]", "a[0].b[0]", "a[0].b[0].c[0]"}
    doc, want = {}, set()
    at = doc
    path = ""
    for name in "abcab":
        at[name] = {}
        at = at[name]
        path = f"{path}.{name}[0]".lstrip(".")
        want.add(path)
    at["x"] = "end"
    assert one(doc) == want
    rows = nested.nested_rows(spark.createDataFrame([(1, "s", None, t, json.dumps({"r": [{"a": {"x": "y", "b": [{"n": 5}, 7, {"n": "6"}]}}]}).encode(), "x")], RAW), schemas)
    tables = nested.documented_tables(schemas, {"s": "r"})
    assert tables == {"r": {}, "r.a": {"x": "$.x"}, "r.a.b": {"n": "$.n"}, "r.a.b.c": {}}
    got = [tuple(r)[:5] for r in nested.child_table(rows, "r.a.b", tables["r.a.b"]).orderBy("node_path").collect()]
    assert got == [(1, "r[0].a[0].b[0]", "r[0].a[0]", [0, 0, 0], "5"), (1, "r[0].a[0].b[2]", "r[0].a[0]", [0, 0, 2], "6")]
