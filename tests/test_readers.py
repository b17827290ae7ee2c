import gzip
import json
from datetime import date, datetime

import pytest

from ledgerweave.sources import readers

RAW = "arrival_seq bigint, source string, account_ref string, payload binary, fetched_at timestamp, refusal string"
STARLING = b"Date,Counter Party,Reference,Type,Amount (GBP),Balance (GBP)\n14/03/2024,Shop,,CARD,-12.50,100.00\n02/04/2024,Boss,PAY,BACS,1000,1100.00\n"
MONZO = "﻿Transaction ID,Date,Time,Type,Name,Description,Amount,Currency\ntx1,01/02/2024,10:00:00,Card,Cafe,,-3.20,GBP\n,01/02/2024,,,Pot,,1.00,GBP\n".encode()
AMEX = b"Date,Description,Amount,Reference,Extended Details\n05/02/2024,SHOP,20.00,'AT123,x\n06/02/2024,PAYMENT,-50.00,,y\n"
QIF = b"!Type:Bank\nD14/3'24\nT-5.25\nPShop\nMmemo\n^\nD1-4-2024\nT7\nMonly memo\n"


def one(source, payload):
    return [r[:11] for r in readers.read_artefact(source, payload)[1]]


def test_file_readers_sign_date_and_identify():
    a, b = one("starling-csv", STARLING)
    assert (a[1], a[3], a[4], a[7], a[8]) == (-1250, date(2024, 3, 14), "Shop", None, "synthetic") and b[4] == "PAY" and b[1] == 100000
    (m,) = one("anything", MONZO)
    assert (m[0], m[1], m[4], m[7], m[8]) == ("monzo-csv", -320, "Cafe", "tx1", "authoritative")
    x, y = one("amex-uk-csv", AMEX)
    assert (x[1], x[7]) == (-2000, "AT123") and (y[1], y[7], y[8]) == (5000, None, "authoritative")
    p, q = one("qif", QIF)
    assert (p[1], p[3], p[4], p[5]) == (-525, date(2024, 3, 14), "Shop", "Shop") and (q[3], q[4], q[5]) == (date(2024, 4, 1), "only memo", "")
    assert one("qif", gzip.compress(QIF)) == [p, q]


@pytest.mark.parametrize("payload", [
    STARLING.replace(b"(GBP)", b"(EUR)", 1), STARLING + b"1/1/2024,a,b,c,1,2,3\n", STARLING.replace(b"Counter Party", b"Party"), STARLING.replace(b"-12.50", b"-12.505"), STARLING.replace(b"14/03/2024", b"2024-03-14"),
    QIF.replace(b"!Type:Bank", b"!Type:Invst"), QIF.replace(b"D14/3'24", b"D02/13/2024"), QIF.replace(b"T-5.25\n", b""), b"", None, b"\x00\x01\x02\x03\x04", b"a,b\n1,2\n", b"%PDF-1.4 x",
])
def test_what_must_be_refused(payload):
    with pytest.raises(readers.Refused):
        readers.read_artefact("file", payload)


def doc(key, *items):
    return json.dumps({key: list(items)}).encode()


BASE = {"timestamp": "2024-03-31T23:30:00+01:00", "amount": 12.5, "currency": "GBP", "description": "", "merchant_name": " Shop ", "transaction_type": "DEBIT", "transaction_id": "volatile"}
ITEM = {"feedItemUid": "u1", "amount": {"currency": "GBP", "minorUnits": 250}, "direction": "OUT", "transactionTime": "2024-01-02T03:04:05Z", "status": "SETTLED", "counterPartyName": "Shop", "source": "INTERNAL_TRANSFER"}


def test_feed_readers_sign_status_and_identify():
    (a,) = one("truelayer-booked", doc("results", BASE))
    assert (a[1], a[3], a[5], a[7], a[8], a[10]) == (-1250, date(2024, 3, 31), "Shop", None, "synthetic", "Shop")
    (b,) = one("truelayer-pending", doc("results", {**BASE, "normalised_provider_transaction_id": "n1"}))
    assert (b[6], b[7], b[8]) == ("pending", "n1", "authoritative")
    (c,) = one("truelayer-card-booked", doc("results", {**BASE, "meta": {"provider_merchant_name": "M"}}))
    assert (c[1], c[5]) == (-1250, "M")
    rows = one("starling-feed", doc("feedItems", ITEM, {**ITEM, "status": "DECLINED"}, {**ITEM, "status": "REVERSED", "direction": "IN", "reference": "ref"}))
    assert [(r[1], r[4], r[6], r[9]) for r in rows] == [(-250, "Shop", "booked", True), (250, "ref", "reversed", True)]
    assert one("starling-feed", doc("feedItems")) == []


@pytest.mark.parametrize("source,payload", [
    ("truelayer-booked", doc("results", {**BASE, "transaction_type": "CREDIT", "amount": -1})), ("truelayer-booked", doc("results", {**BASE, "currency": "EUR"})), ("truelayer-booked", doc("results", {**BASE, "timestamp": ""})),
    ("truelayer-booked", doc("results", {**BASE, "amount": None})), ("truelayer-card-booked", doc("results", {**BASE, "transaction_type": ""})), ("truelayer-card-booked", doc("results", {**BASE, "amount": -3})),
    ("starling-feed", doc("feedItems", {**ITEM, "direction": "?"})), ("starling-feed", doc("feedItems", {**ITEM, "amount": {"minorUnits": 2.5}})), ("starling-feed", doc("feedItems", {**ITEM, "amount": {"minorUnits": True}})), ("starling-feed", b"[1]"),
])
def test_feeds_that_must_be_refused(source, payload):
    with pytest.raises(readers.Refused):
        readers.read_artefact(source, payload)


def test_a_bad_row_refuses_its_artefact_and_no_other(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "qif", "a", QIF, t, "x"), (2, "qif", "a", QIF.replace(b"T7", b"Tseven"), t, "x"), (3, "starling-spaces", "a", b"{}", t, "x"), (4, "truelayer-booked", None, doc("results", BASE), t, "x"), (5, None, "a", None, t, "x")]
    df = spark.createDataFrame(rows, RAW)
    read = readers.read_all(df).checkpoint()
    assert {(r.arrival_seq, r.row_pos) for r in readers.canonical_records(read, df).collect()} == {(1, 0), (1, 1), (4, 0)}
    assert {r.arrival_seq for r in readers.problems(read).collect()} == {2, 5}
    assert readers.read_all(df.where("false")).count() == 0
    assert readers.replay_one(df, 1).count() == 2


def test_accounts_are_resolved_and_registries_checked(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("/feed/account/A/category/C",), ("/feed/account/A/category/D",), ("/x",)], "origin string").withColumn("key", readers.feed_account(F.col("origin"), {"A": "C"}))
    bindings = spark.createDataFrame([("starling", "A", "acc_1")], "source string, provider_account_id string, canonical_id string")
    got = {r.origin: r.account for r in readers.bound_account(F.lit("starling"), F.col("key"), bindings, rows).collect()}
    assert got == {"/feed/account/A/category/C": "acc_1", "/feed/account/A/category/D": "starling:D", "/x": None}
    assert readers.read_registry(str(tmp_path / "none")) == []
    (tmp_path / "bad").write_text("[]")
    with pytest.raises(readers.Refused):
        readers.read_registry(str(tmp_path / "bad"))
