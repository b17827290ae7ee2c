"""Overlapping, nested and gapped day windows per series, through canonical dyadic blocks.

A window of days becomes at most two aligned blocks per level, so repeated and overlapping windows collapse in an ordinary
``distinct`` with map-side combine. What is left of a series is bounded by the calendar (2**LEVELS days), not by its rows, which
is why a series that holds a third of all rows costs no more than any other after that step.

Edge cases: a null bound is open; a window that ends before it begins counts for nothing; null keys form their own series
(null equals null); repeated rows and extra columns change nothing; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The day axis. Day number = days since 1970-01-01 + ORIGIN, within 0 .. 2**LEVELS - 1 (years 1 to 9999 fit).
LEVELS = 22
ORIGIN = 1 << 20
DAYS = 1 << LEVELS


def day_number(day: Column) -> Column:
    return (F.unix_date(day) + F.lit(ORIGIN)).cast("long")


def day_of(number: Column) -> Column:
    return F.date_from_unix_date((number - F.lit(ORIGIN)).cast("int"))


def dyadic_blocks(df: DataFrame, keys: Sequence[str], day_from: str, day_to: str) -> DataFrame:
    """Distinct canonical blocks ``(keys, level, idx)`` that tile the windows exactly."""
    bounds = df.select(
        *keys,
        F.coalesce(day_number(F.col(day_from)), F.lit(0).cast("long")).alias("_a"),
        F.coalesce(day_number(F.col(day_to)) + 1, F.lit(DAYS).cast("long")).alias("_b"),
    ).where("_a < _b").distinct()
    # At level l the uncovered part is [ceil(a / 2^l), floor(b / 2^l)): an odd left end and an odd right end are blocks of this level.
    blocks = F.expr(f"""
        flatten(transform(sequence(0, {LEVELS}), l -> transform(
          array(named_struct('lo', shiftright(_a + shiftleft(1L, l) - 1, l), 'hi', shiftright(_b, l))),
          s -> filter(array(
            named_struct('level', l, 'idx', if(s.lo < s.hi AND s.lo % 2 = 1, s.lo, NULL)),
            named_struct('level', l, 'idx', if(s.hi % 2 = 1 AND s.hi - 1 >= s.lo + s.lo % 2, s.hi - 1, NULL))
          ), b -> b.idx IS NOT NULL))[0]))""")
    return bounds.select(*keys, F.inline(blocks)).distinct()


def continuous_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks without those an ancestor covers, sibling pairs merged upward; ``(keys, start, stop)``, stop exclusive, disjoint."""
    placed = blocks.select(
        *keys, "level", "idx", F.expr("shiftleft(idx, level)").alias("start"), F.expr("shiftleft(idx + 1, level)").alias("stop")
    )
    before = Window.partitionBy(*keys).orderBy("start", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    # Blocks are nested or disjoint, so an earlier block that reaches as far is an ancestor.
    top = placed.withColumn("_reach", F.max("stop").over(before)).where("_reach IS NULL OR _reach < stop")
    grouped = top.groupBy(*keys).agg(F.collect_list(F.struct("level", "idx")).alias("_blocks"))
    merged = F.expr(f"""
        aggregate(
          sequence(0, {LEVELS}),
          named_struct('up', CAST(array() AS array<bigint>), 'done', CAST(array() AS array<struct<start: bigint, stop: bigint>>)),
          (acc, l) -> transform(
            array(array_sort(concat(acc.up, transform(filter(_blocks, b -> b.level = l), b -> b.idx)))),
            cur -> named_struct(
              'up', transform(filter(cur, (x, i) -> x % 2 = 0 AND coalesce(get(cur, i + 1) = x + 1, false)), x -> shiftright(x, 1)),
              'done', concat(acc.done, transform(
                filter(cur, (x, i) -> NOT coalesce(if(x % 2 = 0, get(cur, i + 1) = x + 1, get(cur, i - 1) = x - 1), false)),
                x -> named_struct('start', shiftleft(x, l), 'stop', shiftleft(x + 1, l))))))[0],
          acc -> acc.done)""")
    return grouped.select(*keys, F.inline(merged))


def periods(df: DataFrame, keys: Sequence[str], day_from: str, day_to: str) -> DataFrame:
    """Continuous periods ``(keys, start, stop)`` in day numbers, stop exclusive: touching blocks are one period."""
    tiles = continuous_blocks(dyadic_blocks(df, keys, day_from, day_to), keys)
    w = Window.partitionBy(*keys).orderBy("start")
    return (
        tiles.withColumn("_new", (F.coalesce(F.lag("stop").over(w), F.lit(-1)) != F.col("start")).cast("int"))
        .withColumn("_island", F.sum("_new").over(w))
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_island")
    )


def gaps(period_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The days between consecutive periods: ``(keys, start, stop)``, stop exclusive."""
    w = Window.partitionBy(*keys).orderBy("start")
    return (
        period_rows.withColumn("_after", F.lead("start").over(w))
        .where("_after > stop")
        .select(*keys, F.col("stop").alias("start"), F.col("_after").alias("stop"))
    )


def coverage_gaps(observations: DataFrame, extendable: DataFrame) -> DataFrame:
    """Days that no window of a coverage or promotional series holds, between held days or back to the earliest probe.

    Gives ``account_id, fact, kind, gap_from, gap_to`` as strings. An account probed further back than its first held coverage day
    has those days as a gap too; a first held day of minus infinity leaves none.
    """
    keys = ["account_id", "fact", "kind"]
    rows = observations.select(*keys, "window_from", "window_to").where(F.col("fact").isin("coverage", "promo_rate"))
    held = periods(rows, keys, "window_from", "window_to")
    w = Window.partitionBy(*keys).orderBy("start")
    placed = held.withColumn("_after", F.lead("start").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    probed = (
        extendable.where("probed_back_to IS NOT NULL AND account_id IS NOT NULL")
        .groupBy(F.col("account_id").alias("_account"))
        .agg(F.min(day_number(F.col("probed_back_to"))).alias("_probed"))
    )
    joined = placed.join(probed, (F.col("account_id") == F.col("_account")) & (F.col("fact") == "coverage") & F.col("_first"), "left")
    spans = F.array(
        F.when(F.col("_after") > F.col("stop"), F.struct(F.col("stop").alias("a"), (F.col("_after") - 1).alias("b"))),
        F.when(F.col("_probed") < F.col("start"), F.struct(F.col("_probed").alias("a"), (F.col("start") - 1).alias("b"))),
    )
    return joined.select(*keys, F.inline(F.array_compact(spans))).select(
        *keys, day_of(F.col("a")).cast("string").alias("gap_from"), day_of(F.col("b")).cast("string").alias("gap_to")
    )
