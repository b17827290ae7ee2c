"""Profiles of delivered records: shape by JSON path, duplication on three levels, churn since the first sighting, and disclosure.

Payloads are decoded once to one row per leaf; everything after that is relational. Values leave only where a rule lets them: the shape of a
path that no rule allows keeps counts and lengths and loses its values.

Edge cases: unreadable payloads and payloads without records give nothing; arrays are leaves, as serialised text; null leaves count as
present; a record without a known identity field has none and takes part in no churn; empty inputs give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import common_prefix
from ..sources.artefacts import decode, load_json
from ..sources.readers import RECORD_ARRAYS, rows_of

# Fields that identify a record, in the order in which they are tried, and fields whose change amends a payment.
IDENTITY_FIELDS = ("normalised_provider_transaction_id", "feedItemUid", "transaction_id")
CORE_FIELDS = ("amount", "amount.minorUnits", "timestamp", "transactionTime", "status", "description", "direction", "currency")
#: Up to how many different values a path lists them.
ENUM_MOST = 10

LEAVES = "arrival_seq bigint, source string, fetched_at timestamp, pos int, as_is string, canonical string, identity string, leaves array<struct<path: string, kind: string, value: string>>"


def _leaves(value: object, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        yield path, "list", json.dumps(value, sort_keys=True)
    else:
        kind = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string"}[type(value)]
        yield path, kind, value if isinstance(value, str) or value is None else json.dumps(value)


def _digest(record: dict, canonical: bool) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=canonical, separators=(",", ":")).encode()).hexdigest()


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for seq, source, at, payload in pdf[["arrival_seq", "source", "fetched_at", "payload"]].itertuples(index=False):
            text = decode(payload)
            for k, r in enumerate(rows_of(load_json(text) if text else None, *RECORD_ARRAYS)):
                identity = next((r[f] for f in IDENTITY_FIELDS if isinstance(r.get(f), str) and r[f]), None)
                out.append((seq, source, at, k, _digest(r, False), _digest(r, True), identity, [dict(zip(("path", "kind", "value"), x)) for x in _leaves(r)]))
        yield pd.DataFrame(out, columns=["arrival_seq", "source", "fetched_at", "pos", "as_is", "canonical", "identity", "leaves"])


def record_leaves(artefacts: DataFrame) -> DataFrame:
    """One row per delivered record, with its digests, identity and leaves."""
    return artefacts.select("arrival_seq", "source", "fetched_at", "payload").mapInPandas(_open, LEAVES)


def duplication_levels(records: DataFrame) -> DataFrame:
    """Per source how many records are distinct by bytes, by canonical JSON and by identity, how many carry none, and the share that repeats."""
    per = records.rollup("source").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("as_is").alias("distinct_bytes"), F.count_distinct("canonical").alias("distinct_canonical"), F.count_distinct("identity").alias("distinct_identity"), F.count_if(F.col("identity").isNull()).alias("without_identity"))
    named = F.col("records") - F.col("without_identity")
    return per.withColumn("source", F.coalesce("source", F.lit("TOTAL"))).withColumn("redundancy", F.when(F.col("distinct_identity") > 0, 1 - F.col("distinct_identity") / named).otherwise(0.0))


def churn(records: DataFrame) -> DataFrame:
    """Fields in which later sightings of an identity differ from the first one: ``source, identity, path, changes, amends``.

    Only fields of the later record are compared; a field that left is no churn.
    """
    named = records.where("identity IS NOT NULL")
    first = Window.partitionBy("source", "identity").orderBy("fetched_at", "arrival_seq", "pos")
    held = named.withColumn("_k", F.row_number().over(first)).withColumn("_first", F.first("leaves").over(first))
    differing = F.expr("filter(leaves, x -> NOT exists(_first, y -> y.path = x.path AND y.kind <=> x.kind AND y.value <=> x.value))")
    rows = held.where("_k > 1").select("source", "identity", F.explode(differing).alias("leaf"))
    return rows.groupBy("source", "identity", F.col("leaf.path").alias("path")).agg(F.count(F.lit(1)).alias("changes")).withColumn("amends", F.col("path").isin(*CORE_FIELDS))


def sighting_histogram(records: DataFrame) -> DataFrame:
    """How many identities were seen how often."""
    seen = records.where("identity IS NOT NULL").groupBy("source", "identity").agg(F.count(F.lit(1)).alias("times"))
    return seen.groupBy("times").agg(F.count(F.lit(1)).alias("identities"))


def path_shapes(records: DataFrame, most: int = ENUM_MOST) -> DataFrame:
    """Per source and path: presence, kinds, distinct values, range, lengths, common beginning, format and, where few, the values with counts."""
    cells = records.select("source", F.inline("leaves"))
    tallies = cells.groupBy("source", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    scalar = F.col("kind").isin("string", "number")
    text = F.when(F.col("kind") == "string", F.col("value"))
    number = F.when(F.col("kind") == "number", F.col("value").try_cast("double"))
    formats = {"uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "hex": r"^[0-9a-f]{16,}$", "numeric": r"^\d+$", "iso-datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"}
    fits = [F.every(text.rlike(p) | text.isNull()).alias(f"_{k}") for k, p in enumerate(formats.values())]
    per = tallies.groupBy("source", "path").agg(
        F.sum("n").alias("present"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_if(scalar).alias("distinct_values"), F.min(text).alias("low_text"), F.max(text).alias("high_text"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"), *fits,
    )
    per = per.withColumn("_prefix", common_prefix(F.col("low_text"), F.col("high_text")))
    # Values are listed only for paths that have few, so no list grows with the data.
    few = per.where(f"distinct_values BETWEEN 1 AND {most}").select("source", "path")
    listed = tallies.where(scalar).join(few, ["source", "path"]).groupBy("source", "path").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "value"))).alias("_v"))
    kind = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(formats))):
        kind = F.when(F.col(f"_{k}"), name).otherwise(kind)
    many = (F.col("distinct_values") > most) & F.col("low_text").isNotNull()
    return per.join(listed, ["source", "path"], "left").select(
        "source", "path", "present", "kinds", "distinct_values", "low", "high", F.when(~many, F.col("low_text")).alias("low_text"), F.when(~many, F.col("high_text")).alias("high_text"), "shortest", "longest",
        F.when(many & (F.col("_prefix") != ""), F.col("_prefix")).alias("prefix"), F.when(many, kind).alias("format"),
        F.transform("_v", lambda x: F.struct(x["value"].alias("value"), (-x["neg"]).alias("n"))).alias("listed"),
    )


def disclosed(shapes: DataFrame, rules: Sequence[tuple[str, str]], most: int = 64) -> DataFrame:
    """Shapes with the level of the first rule (pattern on the path or its last part, level) that fits; what no rule allows is withheld.

    ``show`` keeps all, ``shape`` keeps lengths and formats but no values, ``withhold`` keeps counts only. Lists beyond `most` values go too.
    """
    leaf = F.element_at(F.split("path", r"\."), -1)
    level = F.lit("withhold")
    for pattern, name in reversed(rules):
        level = F.when(F.col("path").rlike(pattern) | leaf.rlike(pattern), name).otherwise(level)
    keep = lambda c, *levels: F.when(F.col("level").isin(*levels), F.col(c)).alias(c)
    return shapes.withColumn("level", level).select(
        "source", "path", "level", "present", "kinds", "distinct_values", *[keep(c, "show") for c in ("low", "high", "low_text", "high_text", "prefix")], *[keep(c, "show", "shape") for c in ("shortest", "longest", "format")],
        F.when((F.col("level") == "show") & (F.size("listed") <= most), F.col("listed")).alias("listed"),
    )


def historical_subaccounts(records: DataFrame, current: DataFrame, main: DataFrame) -> DataFrame:
    """Sub-accounts that feeds tell of and no current list does: ``uid, first_day, last_day, items, name, earlier_names``.

    A counterparty of type CATEGORY is a sub-account, unless it is a main account's own category.
    """
    at = lambda p: F.expr(f"get(filter(leaves, x -> x.path = '{p}'), 0).value")
    rows = records.where("source = 'starling-feed'").select(at("counterPartyUid").alias("uid"), at("counterPartyType").alias("type"), F.trim(at("counterPartyName")).alias("name"), F.try_to_date(F.substring(at("transactionTime"), 1, 10), "yyyy-MM-dd").alias("day"))
    rows = rows.where("type = 'CATEGORY' AND uid IS NOT NULL").join(current.select("uid").distinct(), "uid", "left_anti").join(main.select("uid").distinct(), "uid", "left_anti")
    names = rows.where("name <> ''").groupBy("uid", "name").agg(F.max("day").alias("last")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("last", "name"))).alias("_n"))
    per = rows.groupBy("uid").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("items"))
    named = per.join(names, "uid", "left")
    return named.select("uid", "first_day", "last_day", "items", F.expr("try_element_at(_n, -1).name").alias("name"), F.expr("transform(slice(_n, 1, greatest(size(_n) - 1, 0)), x -> x.name)").alias("earlier_names"))
