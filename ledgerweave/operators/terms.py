"""Terms that statements print: observations of them, and rates that are about to end on what is still owed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rung

# Days left and the rung they make.
REVERSION_RUNGS = ((7, 4), (14, 3), (30, 2), (60, 1))


def amount_of(value: Column) -> Column:
    """The number in a printed value in minor units, null when there is none."""
    return (F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("decimal(20,2)") * 100).cast("long")


def reversions(observations: DataFrame, today: Column, facts: Sequence[str] = ("rate", "promo_rate"), ladder: Sequence[tuple[int, int]] = REVERSION_RUNGS) -> DataFrame:
    """Rates whose window ends soon on an account that owes something: ``account_id, window_to, value, owed, rung``.

    What is owed is the latest balance below zero; an end without anything owed is no news.
    """
    balances = observations.where("fact = 'balance'").withColumn("_b", amount_of(F.col("value"))).where("_b IS NOT NULL")
    latest = balances.groupBy("account_id").agg(F.max_by("_b", F.struct("observed_at", "observation_id")).alias("_b")).where("_b < 0")
    ends = observations.where(F.col("fact").isin(*facts) & F.col("window_to").isNotNull()).select("account_id", "window_to", "value").distinct()
    found = ends.withColumn("rung", rung(F.datediff("window_to", today), ladder)).where("rung > 0").join(latest, "account_id")
    return found.select("account_id", "window_to", "value", (-F.col("_b")).alias("owed"), "rung")


def statement_observations(terms: DataFrame) -> DataFrame:
    """Observations out of statement terms ``account_id, stated, rates (map), credit_limit, balance, promos (array of struct kind, value, from, to)``."""
    o = lambda fact, kind, value, a=None, b=None: F.struct(F.lit(fact).alias("fact"), kind.alias("kind"), value.cast("string").alias("value"), (F.lit(None).cast("date") if a is None else a).alias("window_from"), (F.lit(None).cast("date") if b is None else b).alias("window_to"))
    none = F.lit("")
    rates = F.transform(F.map_entries(F.coalesce("rates", F.create_map().cast("map<string,double>"))), lambda e: o("rate", e["key"], e["value"]))
    single = F.array(o("limit", F.lit("credit"), F.col("credit_limit")), o("balance", none, F.col("balance")))
    promos = F.transform(F.coalesce("promos", F.array().cast("array<struct<kind:string,value:double,`from`:date,`to`:date>>")), lambda p: o("promo_rate", p["kind"], p["value"], p["from"], p["to"]))
    return terms.select("account_id", F.col("stated").alias("observed_at"), F.inline(F.concat(rates, single, promos))).where("value IS NOT NULL")
