"""Polling with a cursor that reaches back: overlap, a canary that proves the reach, fallbacks and checks of what came.

A poll asks from a while before the newest update seen. It counts only if it brings the canary, an item known to lie inside the overlap;
without it earlier anchors are tried, then everything. Late and amended items supersede; nothing is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(seen: DataFrame, k: int = 6) -> DataFrame:
    """The newest update instants with an item at each that may serve as canary: ``updated, uid``, newest first."""
    per = seen.where("updated IS NOT NULL").groupBy("updated").agg(F.min("uid").alias("uid"))
    return per.orderBy(F.desc("updated")).limit(k)


def poll(ask: Callable[[datetime | None], set[str]], held: Sequence[tuple[datetime, str]], overlap: timedelta = timedelta(minutes=5)) -> tuple[str, int]:
    """Ask from before each anchor in turn until its canary comes back: how it ended (cursor, fallback or sweep) and how many asks it took.

    `ask(since)` gives the ids that came; with None it sweeps everything. The anchors are few, so this runs on the driver.
    """
    for n, (updated, canary) in enumerate(held, 1):
        if canary in ask(updated - overlap):
            return ("cursor" if n == 1 else "fallback"), n
    ask(None)
    return "sweep", len(held) + 1


def anomalies(came: DataFrame, seen: DataFrame, since: datetime) -> DataFrame:
    """What should not be in a poll: ``uid, kind``: items older than asked for (leak), without an update instant (naked), or whose payment moved in time (moved)."""
    both = came.join(seen.select("uid", F.col("happened").alias("was")).dropDuplicates(["uid"]), "uid", "left")
    kinds = F.array(F.when(F.col("updated") < F.lit(since), "leak"), F.when(F.col("updated").isNull(), "naked"), F.when(F.col("was") != F.col("happened"), "moved"))
    return both.select("uid", F.explode(F.array_compact(kinds)).alias("kind")).distinct()


def missed(sweep: DataFrame, seen: DataFrame) -> DataFrame:
    """Items that a sweep brings and polls never did, or brought in an older state: ``uid``."""
    newest = seen.groupBy("uid").agg(F.max("updated").alias("_u"))
    return sweep.join(newest, "uid", "left").where("_u IS NULL OR _u < updated").select("uid").distinct()


def amended(stream_batch: DataFrame) -> DataFrame:
    """The newest state of each item of a batch; equal instants go to the later arrival."""
    w = Window.partitionBy("uid").orderBy(F.desc_nulls_last("updated"), F.desc("arrival"))
    return stream_batch.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
