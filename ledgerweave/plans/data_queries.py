"""Queries of the general data-processing operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, history, intervals, nested
from ..session import shared_folder
from ..sources.artefacts import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage_gaps(read_table(spark, sf_dir, "observations"), read_table(spark, sf_dir, "extendable_accounts"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["account_id", "fact", "kind"]
    rows = read_table(spark, sf_dir, "observations").where(F.col("fact").isin("coverage", "promo_rate"))
    held = intervals.periods(rows, keys, "window_from", "window_to")
    end = F.when(F.col("start") > 0, intervals.day_of(F.col("start")).cast("string"))
    stop = F.when(F.col("stop") < intervals.DAYS, intervals.day_of(F.col("stop") - 1).cast("string"))
    return held.select(*keys, F.coalesce(end, F.lit("")).alias("period_from"), F.coalesce(stop, F.lit("")).alias("period_to"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    rows = nested.nested_rows(read_table(spark, sf_dir, "raw_artefacts"), read_table(spark, sf_dir, "source_schemas"))
    return rows.select("arrival_seq", "node_path", "parent_path")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(history.readings(read_table(spark, sf_dir, "observations")))


def p6_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = history.reading_periods(history.readings(read_table(spark, sf_dir, "observations")))
    return ledger.select("account_id", "fact", "kind", "observation_id", "plain", "valid_from", "valid_to", F.unix_micros("recorded_from").alias("recorded_from"), F.unix_micros("recorded_to").alias("recorded_to"))


def p6_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger: every valid slice with the instants between which it was believed. p6_ledger has each reading once."""
    ledger = history.bitemporal_ledger(history.readings(read_table(spark, sf_dir, "observations")))
    return ledger.select("account_id", "fact", "kind", "observation_id", "plain", "valid_from", "valid_to", F.unix_micros("recorded_from").alias("recorded_from"), F.unix_micros("recorded_to").alias("recorded_to"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return drift.schema_changes(read_table(spark, sf_dir, "raw_artefacts"), read_table(spark, sf_dir, "source_schemas"))


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each flat table of the nested payloads has, and how many artefacts and parents they come from."""
    shared_folder(spark)
    rows = nested.nested_rows(read_table(spark, sf_dir, "raw_artefacts"), read_table(spark, sf_dir, "source_schemas"))
    return rows.groupBy("table_path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("arrival_seq").alias("artefacts"), F.count_distinct("arrival_seq", "parent_path").alias("parents"))


RECORD_KEYS = {"starling-feed": "feedItems", "starling-spaces": "savingsGoals", "truelayer-booked": "results", "truelayer-pending": "results", "truelayer-card-booked": "results", "truelayer-accounts": "results"}


def _table(path: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared_folder(spark)
        schemas = read_table(spark, sf_dir, "source_schemas")
        rows = nested.nested_rows(read_table(spark, sf_dir, "raw_artefacts"), schemas)
        return nested.child_table(rows, path, nested.documented_tables(schemas, RECORD_KEYS)[path])

    return query


p5_feed_items, p5_attachments, p5_attachment_lines, p5_legs, p5_instalments = (_table(p) for p in ("feedItems", "feedItems.attachments", "feedItems.attachments.pages.lines", "results.meta.legs", "results.meta.instalments"))


def p6_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed on 1 March 2024 about the first day of that year."""
    ledger = history.bitemporal_ledger(history.readings(read_table(spark, sf_dir, "observations")))
    held = history.as_of(ledger, F.lit("2024-01-01").cast("date"), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return held.select("account_id", "fact", "kind", "observation_id", "plain", "valid_from")


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    marks = drift.fingerprints(drift.profiles(read_table(spark, sf_dir, "raw_artefacts")), drift.documented(read_table(spark, sf_dir, "source_schemas"))).checkpoint()
    return drift.SchemaRegistry(spark).register(marks)


def p7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir).select("source", "version", "fingerprint", "undocumented", "missing", "retyped")


def p7_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.migration_steps(_registered(spark, sf_dir))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    rows = drift.consistent_records(read_table(spark, sf_dir, "raw_artefacts"), read_table(spark, sf_dir, "source_schemas"))
    return rows.withColumn("fields", F.col("typed")).withColumn("delivered", F.to_json("delivered")).drop("typed")


QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods, "p5_found": p5_found, "p5_tables": p5_tables, "p6_found": p6_found, "p6_ledger": p6_ledger, "p6_slices": p6_slices, "p7_found": p7_found, "p7_records": p7_records, "p7_versions": p7_versions, "p7_steps": p7_steps, "p6_as_of": p6_as_of, "p5_feed_items": p5_feed_items, "p5_attachments": p5_attachments, "p5_attachment_lines": p5_attachment_lines, "p5_legs": p5_legs, "p5_instalments": p5_instalments}

_HELD = """
WITH w AS (
  SELECT DISTINCT account_id, fact, kind,
         coalesce(window_from - DATE '1970-01-01', -1048576) AS a, coalesce(window_to - DATE '1970-01-01' + 1, 3145728) AS b
  FROM observations WHERE fact IN ('coverage', 'promo_rate')),
o AS (
  SELECT *, max(b) OVER (PARTITION BY account_id, fact, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM w WHERE a < b),
i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY account_id, fact, kind ORDER BY a, b) AS n FROM o),
held AS (SELECT account_id, fact, kind, n, min(a) AS a, max(b) AS b FROM i GROUP BY ALL)
"""

_PLAIN = r"""
WITH r AS (
  SELECT DISTINCT account_id, fact, kind, coalesce(window_from, observed_at) AS start, window_to, observed_at, observation_id, ingested_at,
         CASE WHEN lower(provenance) LIKE 'human%' THEN 2 WHEN lower(provenance) LIKE 'model%' THEN 1 ELSE 0 END AS rank,
         lower(regexp_replace(value, '[\s\x{00A0}]+', '', 'g')) AS squeezed
  FROM observations
  WHERE fact IN ('rate', 'limit', 'name', 'standing') AND regexp_replace(value, '[\s\x{00A0}]+', '', 'g') NOT IN ('', '-')
        AND coalesce(window_from, observed_at) IS NOT NULL),
n AS (
  SELECT *, replace(regexp_extract(squeezed, '^(?:gbp|eur|usd|[£€$])?(-?[0-9][0-9,]*(?:\.[0-9]+)?)(?:gbp|eur|usd|[£€$])?%?(?:p\.?a\.?)?$', 1), ',', '') AS num FROM r),
p AS (SELECT *, CASE WHEN num <> '' THEN CAST(TRY_CAST(num AS DECIMAL(30, 6)) AS VARCHAR) ELSE squeezed END AS plain FROM n)
"""

ORACLES = {
    "p4_found": _HELD
    + """,
g AS (
  SELECT account_id, fact, kind, b AS x, lead(a) OVER (PARTITION BY account_id, fact, kind ORDER BY a) - 1 AS y FROM held
  UNION ALL
  SELECT h.account_id, fact, kind, e.d - DATE '1970-01-01', min(h.a) - 1
  FROM held h JOIN (SELECT account_id, min(probed_back_to) AS d FROM extendable_accounts GROUP BY 1) e ON e.account_id = h.account_id
  WHERE fact = 'coverage' GROUP BY h.account_id, fact, kind, e.d)
SELECT account_id, fact, kind, strftime(DATE '1970-01-01' + CAST(x AS INTEGER), '%Y-%m-%d') AS gap_from,
       strftime(DATE '1970-01-01' + CAST(y AS INTEGER), '%Y-%m-%d') AS gap_to
FROM g WHERE y >= x
""",
    "p4_periods": _HELD
    + """
SELECT account_id, fact, kind, CASE WHEN a = -1048576 THEN '' ELSE strftime(DATE '1970-01-01' + CAST(a AS INTEGER), '%Y-%m-%d') END AS period_from,
       CASE WHEN b = 3145728 THEN '' ELSE strftime(DATE '1970-01-01' + CAST(b - 1 AS INTEGER), '%Y-%m-%d') END AS period_to
FROM held
""",
    "p6_found": _PLAIN
    + """,
b AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, fact, kind, start ORDER BY rank DESC, observed_at DESC NULLS LAST, observation_id DESC) AS k FROM p),
s AS (
  SELECT *, lag(plain) OVER w AS before, lag(window_to) OVER w AS ended FROM b WHERE k = 1 WINDOW w AS (PARTITION BY account_id, fact, kind ORDER BY start)),
v AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> plain OR coalesce(ended < start - 1, false) THEN 1 ELSE 0 END)
              OVER (PARTITION BY account_id, fact, kind ORDER BY start) AS n FROM s),
m AS (SELECT account_id, fact, kind, n, min(start) AS a, arg_max_null(window_to, start) AS z FROM v GROUP BY ALL),
e AS (SELECT *, least(lead(a) OVER (PARTITION BY account_id, fact, kind ORDER BY n) - 1, z) AS y FROM m)
SELECT account_id, fact, kind, strftime(a, '%Y-%m-%d') AS valid_from, coalesce(strftime(y, '%Y-%m-%d'), '') AS valid_to FROM e
""",
    "p6_as_of": _PLAIN
    + """,
k AS (SELECT *, row_number() OVER (PARTITION BY account_id, fact, kind, start ORDER BY rank DESC, observed_at DESC NULLS LAST, observation_id DESC) AS r
      FROM p WHERE ingested_at IS NULL OR ingested_at <= TIMESTAMPTZ '2024-03-01 00:00:00+00'),
q AS (SELECT *, row_number() OVER (PARTITION BY account_id, fact, kind ORDER BY start DESC) AS last FROM k WHERE r = 1 AND start <= DATE '2024-01-01')
SELECT account_id, fact, kind, observation_id, plain, start AS valid_from FROM q WHERE last = 1 AND (window_to IS NULL OR window_to >= DATE '2024-01-01')
""",
    "p6_ledger": _PLAIN
    + """,
h AS (
  SELECT *, max(struct_pack(a := rank, b := observed_at, c := observation_id)) OVER (
    PARTITION BY account_id, fact, kind, start ORDER BY ingested_at NULLS FIRST, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM p),
k AS (SELECT * FROM h WHERE held IS NULL OR held < struct_pack(a := rank, b := observed_at, c := observation_id)),
t AS (SELECT *, lead(ingested_at) OVER (PARTITION BY account_id, fact, kind, start ORDER BY ingested_at NULLS FIRST, observation_id) AS recorded_to FROM k)
SELECT account_id, fact, kind, observation_id, plain, start AS valid_from,
       CAST(min(CASE WHEN recorded_to IS NULL THEN start END) OVER (PARTITION BY account_id, fact, kind ORDER BY start - DATE '1970-01-01'
            RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS DATE) AS valid_to,
       epoch_us(ingested_at) AS recorded_from, epoch_us(recorded_to) AS recorded_to
FROM t
""",
}
