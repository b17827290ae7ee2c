"""Readers with contracts: one canonical record table from every source, and a row for every artefact that was refused.

A reader pins its date layout, its sign and its fields and never guesses; one bad row refuses its whole artefact, which stays landed and
is named with the reason. File exports are recognised by their content, feed documents by their source. Only parsing bytes is Python
(Arrow batches); dispatch, keys and joins are expressions.

Edge cases: null, empty and undecodable payloads are refused as unreadable; sources without movements give neither records nor
refusals; a feed document without records gives none; extra columns are ignored; repeated artefacts give their records again (landing
is what makes them once); an empty table gives empty tables.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_key
from .artefacts import decode, load_json

# Sources whose documents tell of no movements.
NO_MOVEMENTS = ("truelayer-accounts", "truelayer-cards", "truelayer-balance", "truelayer-standing_orders", "truelayer-direct_debits", "starling-accounts", "starling-spaces")
# Names under which a document may keep its records, in the order in which they are tried.
RECORD_ARRAYS = ("results", "feedItems", "booked", "pending", "accounts")
# What a feed item's status means; others never happened.
FEED_STATUS = {"SETTLED": "booked", "REFUNDED": "booked", "PENDING": "pending", "REVERSED": "reversed"}
INTERNAL_SOURCE = "INTERNAL_TRANSFER"
#: Columns that a file must have to be one of a source's exports, in the order in which sources are tried.
HEADERS = {"starling-csv": ("Date", "Counter Party", "Reference", "Type"), "monzo-csv": ("Transaction ID", "Date", "Amount"), "amex-uk-csv": ("Date", "Description", "Amount")}

RECORDS = (
    "arrival_seq bigint, artefact_source string, reader string, row_pos int, source string, amount_minor bigint, currency string, value_date date, description string, "
    "counterparty string, status string, source_id string, tier string, claims_internal boolean, key_text string, refusal string"
)


class Refused(ValueError):
    """Why an artefact cannot be read without guessing."""


def money(text: object, currency: str = "GBP") -> int:
    """Exact minor units of a printed or delivered amount."""
    if currency != "GBP":
        raise Refused(f"currency {currency}")
    bare = str(text).replace(",", "").replace("£", "").replace("+", "").strip()
    sign = -1 if bare.startswith("(") and bare.endswith(")") else 1
    try:
        minor = Decimal(bare[1:-1].strip() if sign < 0 else bare) * 100
    except InvalidOperation:
        raise Refused(f"amount {text!r}") from None
    if not minor.is_finite() or minor != minor.to_integral_value():
        raise Refused(f"amount {text!r}")
    return sign * int(minor)


def day_first(text: str, separators: str = "/", short_years: bool = False) -> date:
    """A calendar day written day, month, year."""
    parts = [p for p in re.split(f"[{re.escape(separators)}]", text.strip()) if p]
    if len(parts) != 3 or not all(p.isascii() and p.strip().isdigit() for p in parts) or not (len(parts[2]) == 4 or short_years and len(parts[2]) == 2):
        raise Refused(f"day {text!r}")
    d, m, y = map(int, parts)
    try:
        return date(y + (2000 if len(parts[2]) == 2 else 0), m, d)
    except ValueError:
        raise Refused(f"day {text!r}") from None


def stamp_day(text: str) -> date:
    """The day of an instant in its own offset."""
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).date()
    except ValueError:
        raise Refused(f"time {text!r}") from None


# Strict access to JSON fields: text is never made of numbers, numbers never of text or truth values.


def text_of(item: dict, name: str, default: str = "") -> str:
    value = item.get(name)
    return value if isinstance(value, str) and value else default


def whole_of(item: dict, name: str) -> int | None:
    value = item.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def object_of(item: dict, name: str) -> dict:
    value = item.get(name)
    return value if isinstance(value, dict) else {}


def rows_of(document: object, *names: str) -> list[dict]:
    """The objects of the first of the named fields that is an array."""
    held = next((document[n] for n in names if isinstance(document.get(n), list)), []) if isinstance(document, dict) else []
    return [r for r in held if isinstance(r, dict)]


def record(amount: int, day: date, description: str, *, source: str, counterparty: str | None = None, currency: str = "GBP", status: str = "booked", source_id: str | None = None, synthetic: bool = False, internal: bool = False, key_text: str | None = None) -> tuple:
    tier = "synthetic" if synthetic else "authoritative"
    return (source, amount, currency, day, description, counterparty, status, source_id, tier, internal, description if key_text is None else key_text)


def table_of(text: str, needed: tuple[str, ...]) -> tuple[list[str], list[dict[str, str]]]:
    """Header and rows of a comma-separated text under the contract that the needed columns are there and no row has surplus cells."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        raise Refused("empty file")
    header = [c.strip() for c in rows[0]]
    missing = [c for c in needed if c not in header]
    if missing:
        raise Refused(f"missing columns {missing}")
    out = []
    for cells in rows[1:]:
        if not cells:
            continue
        if len(cells) > len(header):
            raise Refused("a row has more cells than the header")
        out.append(dict(zip(header, [c.strip() for c in cells] + [""] * (len(header) - len(cells)))))
    return header, out


def starling_csv(text: str) -> Iterator[tuple]:
    """The amount column names the currency; no id; the counterparty stands in for an empty reference."""
    header, rows = table_of(text, HEADERS["starling-csv"])
    column = next((h for h in header if h.startswith("Amount (") and h.endswith(")")), None)
    if column is None:
        raise Refused("no amount column")
    currency = column[8:-1].strip().upper()
    for r in rows:
        yield record(money(r[column], currency), day_first(r["Date"]), r["Reference"] or r["Counter Party"], source="starling-csv", counterparty=r["Counter Party"], currency=currency, synthetic=True)


def monzo_csv(text: str) -> Iterator[tuple]:
    """Rows without an id are the bank's own lines and no movements."""
    for r in table_of(text, HEADERS["monzo-csv"])[1]:
        if r["Transaction ID"]:
            yield record(money(r["Amount"]), day_first(r["Date"]), r.get("Description") or r.get("Name", ""), source="monzo-csv", counterparty=r.get("Name", ""), source_id=r["Transaction ID"])


def amex_csv(text: str) -> Iterator[tuple]:
    """Spending is printed positive, so the sign turns; the id carries a leading quote."""
    for r in table_of(text, HEADERS["amex-uk-csv"])[1]:
        yield record(-money(r["Amount"]), day_first(r["Date"]), r["Description"], source="amex-uk-csv", source_id=r.get("Reference", "").lstrip("'").strip() or None)


def qif(text: str) -> Iterator[tuple]:
    """Letters up to a caret are one record, the last value of a letter counts; investment files have another grammar."""
    if "INVST" in text.lstrip()[:40].upper():
        raise Refused("investment file")
    held: dict[str, str] = {}
    for line in [*text.splitlines(), "^"]:
        line = line.rstrip()
        if line.startswith("^"):
            if held:
                if "D" not in held or "T" not in held:
                    raise Refused("a record without day or amount")
                payee = held.get("P", "")
                yield record(money(held["T"]), day_first(held["D"], "/-.'", True), payee or held.get("M", ""), source="qif", counterparty=payee, synthetic=True)
            held = {}
        elif line and not line.startswith("!"):
            held[line[0]] = line[1:].strip()


def aggregator(items: list[dict], status: str = "booked", card: bool = False) -> Iterator[tuple]:
    """Records of an aggregator: accounts sign their amounts and a type may correct them; cards state spending as positive and the type must agree."""
    for item in items:
        if item.get("amount") is None:
            raise Refused("no amount")
        currency, kind = text_of(item, "currency", "GBP"), text_of(item, "transaction_type").upper()
        amount = money(item["amount"], currency)
        if card:
            if kind not in ("DEBIT", "CREDIT") or (amount < 0 if kind == "DEBIT" else amount > 0):
                raise Refused(f"type {kind!r} against the sign")
            amount = -amount
        elif kind == "DEBIT":
            amount = -abs(amount)
        elif kind == "CREDIT" and amount < 0:
            raise Refused("type 'CREDIT' against the sign")
        when = text_of(item, "timestamp")
        if not when:
            raise Refused("no time")
        description = text_of(item, "description")
        merchant = (str(object_of(item, "meta").get("provider_merchant_name") or "") if card else text_of(item, "merchant_name")).strip()
        durable = text_of(item, "normalised_provider_transaction_id") or None
        yield record(amount, stamp_day(when), description, source="truelayer", counterparty=merchant, currency=currency, status=status, source_id=durable, synthetic=durable is None, key_text=description or merchant)


def feed(items: list[dict]) -> Iterator[tuple]:
    """First-party feed items: unsigned minor units with a direction; items that never happened drop out."""
    for item in items:
        status = FEED_STATUS.get(text_of(item, "status").upper())
        if status is None:
            continue
        amount = object_of(item, "amount")
        currency, minor, direction = text_of(amount, "currency", "GBP"), whole_of(amount, "minorUnits"), text_of(item, "direction").upper()
        if currency != "GBP" or minor is None or direction not in ("IN", "OUT"):
            raise Refused(f"amount {currency} {minor} {direction}")
        when = text_of(item, "transactionTime") or text_of(item, "settlementTime")
        if not when:
            raise Refused("no time")
        party = text_of(item, "counterPartyName").strip()
        yield record(abs(minor) if direction == "IN" else -abs(minor), stamp_day(when), text_of(item, "reference").strip() or party, source="starling", counterparty=party, status=status, source_id=text_of(item, "feedItemUid") or None, internal=text_of(item, "source") == INTERNAL_SOURCE)


FILES: dict[str, Callable[[str], Iterator[tuple]]] = {"starling-csv": starling_csv, "monzo-csv": monzo_csv, "amex-uk-csv": amex_csv}
FEEDS: dict[str, Callable[[list[dict]], Iterator[tuple]]] = {
    "truelayer-booked": aggregator, "truelayer-pending": lambda items: aggregator(items, "pending"), "truelayer-card-booked": lambda items: aggregator(items, card=True), "starling-feed": feed,
}


def detect_file(text: str) -> str:
    """Which file export a text is, by its header; refused when it is none."""
    if text.lstrip()[:6].upper() == "!TYPE:":
        return "qif"
    try:
        header = [c.strip() for c in next(csv.reader(io.StringIO(text)), [])]
    except csv.Error:
        header = []
    found = next((name for name, needed in HEADERS.items() if set(needed) <= set(header)), None)
    if found is None:
        raise Refused("no reader knows this header")
    return found


def read_artefact(source: str | None, payload: bytes | None) -> tuple[str, list[tuple]]:
    """Reader name and all records of one artefact, or :class:`Refused`."""
    text = decode(payload)
    if text is None or not text.strip():
        raise Refused("unreadable")
    if source in FEEDS:
        document = load_json(text)
        if not isinstance(document, dict):
            raise Refused("no JSON object")
        return source, list(FEEDS[source](rows_of(document, *RECORD_ARRAYS)))
    name = detect_file(text)
    return name, list((FILES.get(name) or qif)(text))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for pdf in batches:
        out = []
        for seq, source, payload in pdf[["arrival_seq", "source", "payload"]].itertuples(index=False):
            try:
                reader, rows = read_artefact(source, payload)
                out += [(seq, source, reader, k, *row, None) for k, row in enumerate(rows)]
            except Refused as why:
                out.append((seq, source, None, None, *[None] * 11, str(why)[:200]))
            except (csv.Error, RecursionError) as why:
                out.append((seq, source, None, None, *[None] * 11, type(why).__name__))
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"row_pos": "Int32", "amount_minor": "Int64", "claims_internal": "boolean"})


def read_all(artefacts: DataFrame) -> DataFrame:
    """Records and refusals of all artefacts whose source tells of movements, in one table; decoded once."""
    rows = artefacts.select("arrival_seq", "source", "payload").where(~F.coalesce(F.col("source").isin(*NO_MOVEMENTS), F.lit(False)))
    return rows.mapInPandas(_read, RECORDS)


def canonical_records(read: DataFrame, artefacts: DataFrame) -> DataFrame:
    """The canonical records with their account, artefact digest, content key and occurrence-ready order."""
    landed = artefacts.select("arrival_seq", "account_ref", F.sha2("payload", 256).alias("artefact_digest"))
    rows = read.where("refusal IS NULL").drop("refusal").join(landed, "arrival_seq")
    return rows.select(
        "arrival_seq", "row_pos", "account_ref", "reader", "source", "tier", "source_id", "amount_minor", "currency", "value_date", F.col("value_date").alias("booking_date"), "description", "counterparty", "status",
        "claims_internal", "artefact_digest", content_key(F.col("amount_minor"), F.col("value_date"), F.col("key_text")).alias("content_key"),
    )


def problems(read: DataFrame) -> DataFrame:
    """``arrival_seq, artefact_source, refusal`` of what could not be read."""
    return read.where("refusal IS NOT NULL").select("arrival_seq", "artefact_source", "refusal")


def feed_account(origin: Column, defaults: dict[str, str] | None = None) -> Column:
    """The account key of a first-party feed by its address: the account itself for its default category, else the category."""
    account, category = F.regexp_extract(origin, r"/feed/account/([^/?]+)/category/([^/?]+)", 1), F.regexp_extract(origin, r"/feed/account/([^/?]+)/category/([^/?]+)", 2)
    known = F.create_map(*[F.lit(x) for kv in (defaults or {"": ""}).items() for x in kv])
    return F.when(account != "", F.when(F.try_element_at(known, account) == category, account).otherwise(category))


def bound_account(source: Column, key: Column, bindings: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with ``account``: the canonical account that a provider's key is bound to, else the key qualified by its source."""
    named = bindings.select(F.col("source").alias("_s"), F.col("provider_account_id").alias("_k"), F.col("canonical_id").alias("_c")).dropDuplicates(["_s", "_k"])
    return rows.join(named, (source == F.col("_s")) & (key == F.col("_k")), "left").withColumn("account", F.coalesce("_c", F.concat(source, F.lit(":"), key))).drop("_s", "_k", "_c")


def read_registry(path: str) -> list[dict]:
    """Accounts of a registry file: absent means none, present but of another shape is refused."""
    try:
        with open(path, encoding="utf-8") as file:
            document = json.load(file)
    except FileNotFoundError:
        return []
    except ValueError as why:
        raise Refused(f"registry {why}") from None
    if not isinstance(document, dict) or not isinstance(document.get("accounts"), list) or not all(isinstance(a, dict) and isinstance(a.get("id"), str) for a in document["accounts"]):
        raise Refused("registry without a list of accounts")
    return document["accounts"]


def replay_one(artefacts: DataFrame, arrival_seq: int) -> DataFrame:
    """The records of one artefact; pending snapshots cannot be replayed alone, for absence from them has a meaning."""
    one = artefacts.where(F.col("arrival_seq") == arrival_seq)
    if one.where("source LIKE '%-pending'").take(1):
        raise Refused("a pending snapshot is replayed with its account, not alone")
    return canonical_records(read_all(one), one)
