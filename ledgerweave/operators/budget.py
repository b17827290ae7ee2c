"""What leaves the ledger: budget payloads and envelopes, audits and prunes, declared exports, backups, runs, outboxes and valuations.

Edge cases: rows without account, content key or day leave nothing; void rows never leave; an empty expected set refuses to prune; repeated
rows count once where an identifier is meant; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload(rows: DataFrame, bindings: DataFrame, confirmed: DataFrame, include_internal: bool = False) -> DataFrame:
    """Rows as a budgeting application takes them: void, unbound and (unless asked for) internal rows stay out; only GBP leaves.

    `bindings`: ``account_id, target``; `confirmed`: ``entity_id`` of legs that pairing proved. Notes say what the payee does not.
    """
    held = rows.where("status <> 'void' AND content_key IS NOT NULL AND upper(trim(currency)) IN ('GBP', '')").join(bindings, "account_id")
    held = held.join(confirmed.select("entity_id", F.lit(True).alias("_c")).distinct(), "entity_id", "left")
    proved, claimed = F.coalesce("_c", F.lit(False)), F.coalesce("is_internal_transfer", F.lit(False))
    if not include_internal:
        held = held.where(~proved & ~claimed)
    payee = F.coalesce(F.nullif(F.trim("counterparty"), F.lit("")), "description")
    said = F.nullif(F.col("description"), F.lit(""))
    notes = F.concat_ws(" | ", F.when(said != payee, said), F.when(proved, "internal transfer").when(claimed, "internal transfer (unpaired claim)"), F.when(F.col("status") == "pending", "pending"))
    return held.select("target", F.concat("content_key", F.lit(":"), F.col("occurrence").cast("string")).alias("imported_id"), "value_date", "amount_minor", payee.alias("payee"), notes.alias("notes"), (F.col("status") != "pending").alias("cleared")).distinct()


def push_envelope(out: DataFrame) -> DataFrame:
    """One row per target: rows to push and how many ids repeat; a target with a repeated id is refused."""
    each = out.groupBy("target", "imported_id").agg(F.count(F.lit(1)).alias("k"))
    per = each.groupBy("target").agg(F.sum("k").alias("rows"), F.count_if(F.col("k") > 1).alias("repeated_ids"))
    return per.withColumn("refused", F.col("repeated_ids") > 0)


def audit_envelope(bindings: DataFrame, out: DataFrame) -> DataFrame:
    """Every bound target with its number of rows, 0 where nothing is to be there."""
    n = out.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return bindings.select("target").distinct().join(n, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("rows"))


def provision(accounts: DataFrame) -> DataFrame:
    """Labels for targets to create: a label that several accounts share falls back to the slug, else to the id."""
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    rows = accounts.select("account_id", "account_slug", "label").distinct().withColumn("_n", n)
    return rows.select("account_id", F.when((F.col("_n") == 1) & F.col("label").isNotNull(), F.col("label")).otherwise(F.coalesce("account_slug", "account_id")).alias("label"))


def prune_candidates(actual: DataFrame, expected: DataFrame, owned: Column) -> DataFrame:
    """Rows there that this engine put there and no longer expects. An empty expectation would prune everything and is refused."""
    if expected.isEmpty():
        raise ValueError("nothing is expected; refusing to prune everything")
    return actual.where(owned).join(expected.select("imported_id").distinct(), "imported_id", "left_anti")


def declared_export(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions keyed on content and occurrence instead of ids, those whose payment is gone marked as orphans."""
    keyed = rows.select("entity_id", "content_key", "occurrence").distinct().groupBy("entity_id").agg(F.min(F.struct("content_key", "occurrence")).alias("k"))
    return decisions.join(keyed, "entity_id", "left").select("entity_id", "kind", "value", F.col("k.content_key").alias("content_key"), F.col("k.occurrence").alias("occurrence"), F.col("k").isNull().alias("orphan"))


def verify_backup(before: DataFrame, copy: DataFrame, after: DataFrame) -> DataFrame:
    """Per table whether the copy's count lies between the source's before and after: ``name, low, copied, high, ok``."""
    ends = before.select("name", F.col("n").alias("b")).join(after.select("name", F.col("n").alias("a")), "name", "full").select("name", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    both = ends.join(copy.select("name", F.col("n").alias("copied")), "name", "full")
    return both.select("name", "low", "copied", "high", F.coalesce(F.col("copied").between(F.col("low"), F.col("high")), F.lit(False)).alias("ok"))


def unpublished(events: DataFrame) -> DataFrame:
    """Outbox rows that wait, in the order in which they happened."""
    return events.where("published_at IS NULL").orderBy("created_at", "id")


def newest_runs(runs: DataFrame, k: int) -> DataFrame:
    """The `k` newest runs of each kind."""
    w = Window.partitionBy("kind").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def valuations(rows: DataFrame) -> DataFrame:
    """The last write per asset, day and source; a row must hold a value or a yearly income and not both."""
    good = rows.where(F.col("value_minor").isNull() != F.col("annual_income_minor").isNull())
    last = F.max_by(F.struct("value_minor", "annual_income_minor"), F.struct("ingested_at", "seq"))
    return good.groupBy("asset_id", "observed_at", "source").agg(last.alias("v")).select("asset_id", "observed_at", "source", "v.value_minor", "v.annual_income_minor")


def timings(phases: DataFrame, order: str = "total") -> DataFrame:
    """Per phase how often it ran and its total, least, middle and longest seconds."""
    s = F.col("seconds")
    return phases.groupBy("phase").agg(F.count(s).alias("runs"), F.sum(s).alias("total"), F.min(s).alias("least"), F.percentile(s, 0.5).alias("middle"), F.max(s).alias("longest")).orderBy(F.desc(order), "phase")


def irreplaceable(parts: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each kind no source could give again: ``kind, n``."""
    out = None
    for kind, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out
