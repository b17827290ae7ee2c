"""Pending payments against the latest complete set of them: who vanished, and what each became.

Absence from the newest snapshot of an account voids a held pending payment: by its id if it has one, else by amount and day. A vanished one
settled if a booked payment of the account and direction followed within five days whose condensed text holds its own or is held by it;
else it was released. Amounts may differ: that is what settling often changes.

Edge cases: an account without any snapshot keeps its pending rows; an empty snapshot voids all of them; null texts match nothing; ties go
to the earliest arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import condense

SETTLE_DAYS = 5


def vanished(pending: DataFrame, snapshots: DataFrame, present: DataFrame) -> DataFrame:
    """Held pending rows that the newest snapshot of their account lacks.

    `pending`: ``entity_id, account_id, source_id, amount_minor, value_date, description``; `snapshots`: the accounts that have one, be it
    empty; `present`: what it holds (``account_id, source_id, amount_minor, value_date``). An anti join per kind of key.
    """
    held = pending.join(snapshots.select("account_id").distinct(), "account_id", "left_semi")
    named = F.col("source_id").isNotNull() & (F.col("source_id") != "")
    by_id = held.where(named).join(present.where(named).select("account_id", "source_id").distinct(), ["account_id", "source_id"], "left_anti").select(*held.columns)
    by_day = held.where(~named | F.col("source_id").isNull()).join(present.select("account_id", "amount_minor", "value_date").distinct(), ["account_id", "amount_minor", "value_date"], "left_anti").select(*held.columns)
    return by_id.unionByName(by_day)


def outcomes(gone: DataFrame, booked: DataFrame, days: int = SETTLE_DAYS) -> DataFrame:
    """``entity_id, outcome, settled_id, settled_amount`` of vanished rows. `booked` has ``entity_id, account_id, amount_minor, value_date, description, arrival``."""
    out = F.col("amount_minor") < 0
    asks = gone.select("entity_id", "account_id", out.alias("_out"), F.explode(F.sequence("value_date", F.date_add("value_date", days))).alias("value_date"), condense(F.col("description")).alias("_own"))
    offers = booked.select(F.col("entity_id").alias("settled_id"), "account_id", out.alias("_out"), "value_date", F.col("amount_minor").alias("settled_amount"), condense(F.col("description")).alias("_other"), "arrival")
    near = asks.join(offers, ["account_id", "_out", "value_date"]).where("_own <> '' AND _other <> '' AND (contains(_own, _other) OR contains(_other, _own))")
    first = near.groupBy("entity_id").agg(F.min_by(F.struct("settled_id", "settled_amount"), F.struct("arrival", "settled_id")).alias("s"))
    return gone.select("entity_id").distinct().join(first, "entity_id", "left").select("entity_id", F.when(F.col("s").isNotNull(), "settled").otherwise("released").alias("outcome"), "s.settled_id", "s.settled_amount")


def events(resolved: DataFrame) -> DataFrame:
    """Outbox rows of resolved pendings: ``kind, entity_id, payload``. A recomputation writes none, a live pull does."""
    payload = F.to_json(F.struct("settled_id", "settled_amount"))
    return resolved.select(F.concat(F.lit("pending_"), "outcome").alias("kind"), "entity_id", payload.alias("payload"))
