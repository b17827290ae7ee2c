"""Mixing sources to target shares of the total size by systematic sampling.

Sizes are tokens of a public tokenizer. A source's documents stand in a fixed order (size class, hash bucket, size, hash); each expects
``share * total / tokens of the source`` copies. The prefix sum of these expectations plus one offset per source crosses integers, and a
document is emitted once per crossing: never more than the cap, and because neighbours in the order are alike in size, the attained size
follows the expected one closely.

The order is global per source but needs no global sort: positions come from a histogram of (source, size class, bucket), which is
bounded by sources x 128 classes x ``BUCKETS`` whatever the corpus, and a rank inside one bucket.

The total is the largest at which every source attains its exact share within its cap, unless a total is given; then a source that
cannot attain its share gives all it may, and the others divide the rest by their targets.

Edge cases: documents without tokens, without source or of a source without target take no part and get 0 copies; a target without
documents attains 0 and the others share the total by their targets; null or non-positive targets and caps give 0; repeated targets of
one source add up with the largest cap; repeated documents are documents of their own; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import NAME, TOKENIZERS, count_tokens

#: Hash buckets per size class of a source.
BUCKETS = 256


def plain_source(source: Column) -> Column:
    """A source name without letter case, outer blanks and differing separators."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_\-./]+", "-")


def measured(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, source, n_tokens`` with plain source names; written once, for it is read several times."""
    return count_tokens(documents, tokenizers, name).withColumn("source", plain_source(F.col("source"))).checkpoint()


def allotments(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, tokens, allotted, copies_each`` per target source."""
    goal = (
        targets.select(plain_source(F.col("source")).alias("source"), F.greatest("target_share", F.lit(0.0)).alias("target_share"), F.greatest("max_repeats", F.lit(0)).alias("max_repeats"))
        .where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = goal.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("_cap", F.col("tokens") * F.col("max_repeats"))
    usable = (F.col("_cap") > 0) & (F.col("target_share") > 0)
    rows = rows.withColumn("_share", F.when(usable, F.col("target_share")).otherwise(0.0))
    everyone = Window.partitionBy()  # the targets are one short list
    if total is None:
        whole = F.min(F.when(usable, F.col("_cap") / F.col("_share"))).over(everyone)
        rows = rows.withColumn("allotted", F.coalesce(F.col("_share") * whole, F.lit(0.0)))
    else:
        # Fill in the order of how soon a source reaches its cap: those before have given all, the rest divide what is left.
        early = Window.orderBy((F.col("_cap") / F.nullif("_share", F.lit(0.0))).asc_nulls_last(), "source")
        before = early.rowsBetween(Window.unboundedPreceding, -1)
        after = early.rowsBetween(0, Window.unboundedFollowing)
        left = F.lit(float(total)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
        rate = left / F.nullif(F.sum("_share").over(after), F.lit(0.0))
        rows = rows.withColumn("_rate", rate).withColumn("_full", F.coalesce(F.col("_cap") <= F.col("_rate") * F.col("_share"), F.lit(True)))
        rows = rows.withColumn("_open", F.min(F.when(~F.col("_full"), F.col("_rate"))).over(everyone))
        rows = rows.withColumn("allotted", F.when(F.col("_share") <= 0, 0.0).otherwise(F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_open") * F.col("_share"), F.col("_cap").cast("double")))))
    return rows.select("source", "target_share", "max_repeats", "tokens", "allotted", F.when(F.col("tokens") > 0, F.col("allotted") / F.col("tokens")).otherwise(0.0).alias("copies_each"))


def offset(source: Column, seed: int) -> Column:
    """One offset in [0, 1) per source."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(sizes: DataFrame, allotted: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the documents to take."""
    size_class = F.floor(4 * F.log2("n_tokens")).cast("int")
    key = F.xxhash64(F.lit(seed), "doc_id")
    placed = sizes.where("n_tokens > 0 AND source IS NOT NULL").withColumn("_class", size_class).withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(BUCKETS)))
    bins = placed.groupBy("source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("source", "_class", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")).join(F.broadcast(allotted.select("source", "copies_each")), "source")
    rank = F.row_number().over(Window.partitionBy("source", "_class", "_bucket").orderBy("n_tokens", "_key", "doc_id"))
    ranked = placed.withColumn("_rank", rank).join(starts, ["source", "_class", "_bucket"])
    upto = lambda k: F.floor(offset(F.col("source"), seed) + (F.col("_start") + k) * F.col("copies_each"))
    copies = (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("int")
    return ranked.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, allotted: DataFrame) -> DataFrame:
    """What each target source attained: ``source, target_share, max_repeats, documents, tokens, most_copies, attained_share``."""
    took = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    rows = allotted.select("source", "target_share", "max_repeats").join(took, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("attained_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
