"""Entity resolution: the ordered fold of observations into payments.

The state after each observation decides the next one, so the fold is sequential among rows that can touch each other, through an
equal amount or an equal id, and parallel across these parts of accounts; only slim columns are shuffled. Ladder for one observation: equal durable id; else equal content that may be the same payment, first by
arrival; else equal amount within the window, nearest day, then arrival. A match supersedes the held payment in its arrival slot and
keeps its entity id; otherwise a new payment begins, flagged for review when something came close and no series explains it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from datetime import date
from heapq import nlargest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import in_order

WINDOW_DAYS, MANUAL_DAYS = 7, 10

SCHEMA = "event_id bigint, account_id string, entity_id string, match_tier string, needs_review boolean"
OBSERVED = ["event_id", "account_id", "source", "tier", "source_id", "amount_minor", "value_date", "status", "content_key", "occurrence", "arrival_seq", "description", "artefact_digest"]


def may_be_one(new: dict, held: dict, same_content: bool) -> bool:
    """The decision ladder on two observations."""
    manual = (new["tier"] == "manual") + (held["tier"] == "manual")
    if manual:
        return manual == 1
    if new["source"] != held["source"] or (new["status"] == "pending") != (held["status"] == "pending"):
        return True
    if new["tier"] == held["tier"] == "authoritative" and new["source_id"] and held["source_id"]:
        return new["source_id"] == held["source_id"]
    return same_content and new["occurrence"] == held["occurrence"]


def window_of(new: dict, held: dict) -> int:
    return MANUAL_DAYS if "manual" in (new["tier"], held["tier"]) else WINDOW_DAYS


def mint(new: dict) -> str:
    """The id of a payment by its first sighting, as ``functions.scalars.entity_id`` gives it."""
    own = new["source_id"] or f"{new['content_key']}#{new['occurrence']}"
    return hashlib.sha256("\x1f".join((new["account_id"], new["source"], own, new["artefact_digest"])).encode()).hexdigest()[:32]


class Held:
    """Payments in arrival slots, filed by id, by content, and by amount and day."""

    def __init__(self) -> None:
        self.slots: list[dict] = []
        self.by: dict[tuple, set[int]] = {}
        self.days: dict[tuple, Counter] = {}

    @staticmethod
    def _keys(row: dict) -> list[tuple]:
        keys = [("content", row["content_key"]), ("amount", row["amount_minor"], row["value_date"].toordinal())]
        return keys + ([("id", row["source"], row["source_id"])] if row["source_id"] else [])

    def put(self, row: dict, slot: int | None = None) -> None:
        if slot is None:
            slot = len(self.slots)
            self.slots.append(row)
        else:
            old = self.slots[slot]
            for key in self._keys(old):
                self.by[key].discard(slot)
            self._count(old, -1)
            self.slots[slot] = row
        for key in self._keys(row):
            self.by.setdefault(key, set()).add(slot)
        self._count(row, 1)

    def _count(self, row: dict, by: int) -> None:
        days = self.days.setdefault((row["amount_minor"], row["description"]), Counter())
        days[row["value_date"]] += by
        if not days[row["value_date"]]:
            del days[row["value_date"]]

    def at(self, *key: object) -> list[int]:
        return sorted(self.by.get(key, ()))

    def near(self, amount: int, day: date, reach: int) -> list[int]:
        """Slots of an amount within the reach of a day; what lies further is never looked at."""
        return [k for d in range(day.toordinal() - reach, day.toordinal() + reach + 1) for k in self.by.get(("amount", amount, d), ())]

    def recurring(self, new: dict) -> bool:
        """Whether the two last earlier days of equal amount and text stand as far apart as the new one, within a day."""
        days = nlargest(2, (d for d in self.days.get((new["amount_minor"], new["description"]), ()) if d < new["value_date"]))
        return len(days) == 2 and abs((new["value_date"] - days[0]).days - (days[0] - days[1]).days) <= 1


def superseded(new: dict, old: dict) -> dict:
    """The newest facts under the held payment's id; the earliest booking day, a claim once made and a known counterparty stay."""
    kept = {**new, "entity_id": old["entity_id"]}
    if "booking_date" in new:
        days = [d for d in (new["booking_date"], old["booking_date"]) if d]
        kept.update(booking_date=min(days) if days else None, claimed=bool(new["claimed"] or old["claimed"]), counterparty=new["counterparty"] or old["counterparty"])
    return kept


def fold_account(rows: list[dict]) -> list[tuple]:
    """The trace of rows that can touch each other: (event_id, account_id, entity_id, match_tier, needs_review) per observation, in order."""
    held, out = Held(), []
    for new in rows:
        slot, tier, close = None, "unresolved", []
        if new["source_id"] and (hits := held.at("id", new["source"], new["source_id"])):
            slot, tier = hits[0], "source_id"
        if slot is None and (hits := [k for k in held.at("content", new["content_key"]) if may_be_one(new, held.slots[k], True)]):
            slot, tier = hits[0], "content_key"
        if slot is None:
            apart = lambda k: abs((new["value_date"] - held.slots[k]["value_date"]).days)
            close = [k for k in held.near(new["amount_minor"], new["value_date"], MANUAL_DAYS) if apart(k) <= window_of(new, held.slots[k])]
            if hits := [k for k in close if may_be_one(new, held.slots[k], new["content_key"] == held.slots[k]["content_key"])]:
                slot, tier = min(hits, key=lambda k: (apart(k), k)), "fuzzy"
        if slot is None:
            entity, review = mint(new), bool(close) and not held.recurring(new)
            held.put({**new, "entity_id": entity})
        else:
            kept = superseded(new, held.slots[slot])
            entity, review = kept["entity_id"], False
            held.put(kept, slot)
        out.append((new["event_id"], new["account_id"], entity, tier, review))
    return out


def components(keyed: DataFrame) -> DataFrame:
    """``account_id, amount_minor, part``: amounts of an account whose rows can touch each other, because a source gave one id several amounts.

    Rows touch only through an equal amount or an equal id, so parts fold apart from each other. Only amounts tied by an id are walked,
    in rounds of smallest labels until nothing changes.
    """
    ids = keyed.where("source_id IS NOT NULL AND source_id <> ''").select("account_id", "source", "source_id", "amount_minor").distinct()
    several = ids.groupBy("account_id", "source", "source_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("account_id", F.xxhash64("source", "source_id").alias("tie"), "source", "source_id")
    links = ids.join(several, ["account_id", "source", "source_id"]).select("account_id", "tie", "amount_minor").checkpoint()
    labels = links.select("account_id", "amount_minor", F.col("amount_minor").alias("part")).distinct()
    while True:
        low = links.join(labels, ["account_id", "amount_minor"]).groupBy("account_id", "tie").agg(F.min("part").alias("low"))
        fresh = links.join(low, ["account_id", "tie"]).groupBy("account_id", "amount_minor").agg(F.min("low").alias("low"))
        # Half-way jumps: a label that has a smaller label itself is replaced by it at once.
        step = labels.join(fresh, ["account_id", "amount_minor"]).select("account_id", "amount_minor", "part", F.least("part", "low").alias("next"))
        jump = step.alias("a").join(step.select("account_id", F.col("amount_minor").alias("next"), F.col("next").alias("far")), ["account_id", "next"], "left")
        done = jump.select("account_id", "amount_minor", "part", F.least("next", F.coalesce("far", "next")).alias("next")).checkpoint()
        changed = not done.where("part <> next").isEmpty()
        labels = done.select("account_id", "amount_minor", F.col("next").alias("part"))
        if not changed:
            return labels


def resolve(keyed: DataFrame) -> DataFrame:
    """Fold all observations in arrival order; one trace row per observation. An account is split into what can touch each other."""
    tied = components(keyed)
    placed = keyed.where("amount_minor IS NOT NULL AND value_date IS NOT NULL").select(*OBSERVED).join(tied, ["account_id", "amount_minor"], "left").withColumn("part", F.coalesce("part", "amount_minor"))

    names = [c for c in OBSERVED if c != "account_id"]
    return in_order(placed.select("account_id", "part", *names), ["account_id", "part"], ["arrival_seq"], lambda key: _Part(key[0], names), SCHEMA)


class _Part:
    """Gathers the rows of one part, which come in arrival order, and folds them."""

    def __init__(self, account: str, names: list[str]) -> None:
        self.account, self.names, self.rows = account, names, []

    def push(self, row: tuple) -> list[tuple]:
        self.rows.append({"account_id": self.account, **dict(zip(self.names, row))})
        return []

    def close(self) -> list[tuple]:
        return fold_account(self.rows)
