"""One-to-one matching under a window of days: leftovers, siblings and transfers.

Who is matched first decides what is left for the next, so a match is a walk in order. The walk is cut as fine as its rule allows
(equal amount, then runs of neighbouring days) and reads its rows as a stream: a partition is sorted by Spark, a walker holds only the
rows inside the window, so a usual amount with a third of all rows costs time in one task but no memory.

Edge cases: null accounts, sources and texts are keys of their own; rows without day or amount take no part; repeated rows are rows of
their own; ties go by day, text and event_id; an empty input gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import case_folded


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], walk: Callable[[tuple], Any], schema: str) -> DataFrame:
    """Every group's rows in order through a walker of its own, as a stream.

    `walk(key)` gives an object with ``push(row)`` and ``close()``, both giving output rows; a row is the tuple of the columns after the keys.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    n = len(keys)
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cells = list(zip(*rows)) if rows else [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cells, target)], schema=target)

        now, walker = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if walker is None or row[:n] != now:
                    if walker is not None:
                        out.extend(walker.close())
                    now, walker = row[:n], walk(row[:n])
                out.extend(walker.push(row[n:]))
            yield batch_of(out)
        if walker is not None:
            yield batch_of(walker.close())

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class TakenByDay:
    """How many rows of each day and side are taken when each asking row takes the nearest free offer within the window, once.

    Rows are ``(day, mine, n)`` by day. Rows of a day and side are alike but for their order, so those that come first are served first and
    taken first, and numbers tell all; ties go to the earlier day. Gives ``(*key, day, mine, taken)`` where rows are left.
    """

    def __init__(self, key: tuple, days: int) -> None:
        self.key, self.steps = key, [timedelta(k) for k in range(days + 1)]
        self.asks: deque = deque()
        self.offers: dict[date, list[int]] = {}

    def push(self, row: tuple) -> list[tuple]:
        day, mine, n = row
        out = self._settle(day)
        if mine:
            self.asks.append((day, n))
        else:
            self.offers[day] = [n, 0]
        return out

    def close(self) -> list[tuple]:
        return self._settle(None)

    def _settle(self, now: date | None) -> list[tuple]:
        out = []
        while self.asks and (now is None or now - self.asks[0][0] > self.steps[-1]):
            day, n = self.asks.popleft()
            open_ = n
            for step in self.steps:
                for there in (day - step, day + step):
                    if open_ and (offer := self.offers.get(there)):
                        take = min(open_, offer[0] - offer[1])
                        open_ -= take
                        offer[1] += take
            if open_:
                out.append((*self.key, day, True, n - open_))
        oldest = self.asks[0][0] if self.asks else now
        for day in [d for d in self.offers if oldest is None or oldest - d > self.steps[-1]]:
            n, taken = self.offers.pop(day)
            if taken < n:
                out.append((*self.key, day, False, taken))
        return out


class NearestOffer:
    """Each asking row takes the nearest offer of another account that its account and source have not taken before; ties go to the offer that
    came first.

    Rows are ``(day, mine, sign, id, account, source)`` by day; an offer has no source. Offers of the other sign count only within `flipped`
    days and after those of the same sign at equal distance. All askers read the same offers: each takes those of a day and sign from the
    front, so a place in the list is all there is to keep of what it took.
    """

    def __init__(self, key: tuple, days: int, flipped: int) -> None:
        self.key, self.days = key, timedelta(max(days, flipped))
        self.steps = [(timedelta(k), turn) for k in range(max(days, flipped) + 1) for turn in (1, -1) if k <= (days if turn == 1 else flipped)]
        self.asks: deque = deque()
        self.offers: dict[date, dict[int, tuple[list, dict]]] = {}

    def push(self, row: tuple) -> list[tuple]:
        day, mine, sign, event, account, _ = row
        out = self._settle(day)
        if mine:
            self.asks.append(row)
        else:
            self.offers.setdefault(day, {}).setdefault(sign, ([], {}))[0].append((event, account))
        return out

    def close(self) -> list[tuple]:
        return self._settle(None)

    def _settle(self, now: date | None) -> list[tuple]:
        out = []
        while self.asks and (now is None or now - self.asks[0][0] > self.days):
            day, _, sign, event, account, source = self.asks.popleft()
            out.append((account, source, self.key[0], event, *self._nearest(day, sign, account, source)))
        oldest = self.asks[0][0] if self.asks else now
        for day in [d for d in self.offers if oldest is None or oldest - d > self.days]:
            del self.offers[day]
        return out

    def _nearest(self, day: date, sign: int, account: str, source: str) -> tuple:
        for step, turn in self.steps:
            for there in (day - step, day + step):
                if there not in self.offers or sign * turn not in self.offers[there]:
                    continue
                offers, places = self.offers[there][sign * turn]
                at = places.get((account, source), 0)
                while at < len(offers) and offers[at][1] == account:
                    at += 1
                places[account, source] = at + 1 if at < len(offers) else at
                if at < len(offers):
                    return (*offers[at], turn == -1)
        return None, None, None


def _runs(df: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """Rows with the number of the run of neighbouring days they lie in."""
    w = Window.partitionBy(*keys).orderBy("value_date")
    cut = F.coalesce((F.datediff("value_date", F.lag("value_date").over(w)) > days).cast("int"), F.lit(0))
    return df.withColumn("_run", F.sum(cut).over(w))


SIDES = ["account_id", "left_source", "right_source"]


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("description", "event_id")))


def _over(numbers: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """Of `numbers` (keys, ``value_date, mine, n``) the days and sides with rows left over, and how many of their rows are ``taken``."""
    placed = _runs(numbers, keys, days).select(*keys, "_run", "value_date", "mine", F.col("n").cast("bigint").alias("n"))
    schema = ", ".join(f"{c} {kind}" for c, kind in placed.withColumnRenamed("n", "taken").dtypes)
    return in_order(placed, [*keys, "_run"], ["value_date"], lambda key: TakenByDay(key, days), schema).drop("_run")


def leftovers(rows: DataFrame, days: int = 2, skew_days: int = 7) -> DataFrame:
    """Rows of one source that no row of another source of the account consumes one to one: ``account_id, left_source, right_source, event_id, side``.

    First by equal amount within `days`; what is left then by equal amount and text (letter case and outer blanks aside) within `skew_days`.
    Only numbers of rows are walked; the rows themselves are numbered within their day and those after the taken ones are left.
    """
    slim = rows.where("value_date IS NOT NULL AND amount_minor IS NOT NULL").select("account_id", "amount_minor", "source", "value_date", "event_id", "description")
    seen = slim.select("account_id", "source").distinct()
    pairs = seen.withColumnRenamed("source", "left_source").join(seen.withColumnRenamed("source", "right_source"), "account_id").where("left_source < right_source")
    group = ["account_id", "source", "amount_minor", "value_date"]
    placed = _numbered(slim, group)
    both = placed.groupBy(*group).agg(F.max("_place").alias("n")).join(pairs, "account_id").where("source IN (left_source, right_source)").withColumn("mine", F.col("source") == F.col("left_source"))
    first = _over(both, [*SIDES, "amount_minor"], days).withColumn("source", F.when(F.col("mine"), F.col("left_source")).otherwise(F.col("right_source")))
    # A text that is null is a key of its own.
    text = F.coalesce(F.concat(F.lit("="), case_folded(F.trim("description"))), F.lit(""))
    rest = placed.join(first, group).where("_place > taken").select(*SIDES, "mine", text.alias("text"), "amount_minor", "value_date", "event_id", "description")
    group = [*SIDES, "mine", "text", "amount_minor", "value_date"]
    placed = _numbered(rest, group)
    second = _over(placed.groupBy(*group).agg(F.max("_place").alias("n")), [*SIDES, "text", "amount_minor"], skew_days)
    side = F.when(F.col("mine"), F.col("left_source")).otherwise(F.col("right_source"))
    return placed.join(second, group).where("_place > taken").select(*SIDES, "event_id", side.alias("side"))


def sibling_attribution(rows: DataFrame, left: DataFrame, same_days: int = 2, opposite_days: int = 1) -> DataFrame:
    """Leftover rows with the row that the other source filed under another account, if any.

    `left` is what :func:`leftovers` gives. Equal amounts count within `same_days`, opposite ones within `opposite_days`; the nearest
    offer wins, the same sign before the opposite one; every offer is consumed once by an account and pair of sources.
    Columns: ``account_id, source, other_source, event_id, sibling_event_id, sibling_account, opposite_sign`` (null: unexplained).
    """
    slim = rows.where("value_date IS NOT NULL AND amount_minor IS NOT NULL").select("event_id", "account_id", "source", "value_date", "amount_minor", "description")
    other = F.when(F.col("side") == F.col("left_source"), F.col("right_source")).otherwise(F.col("left_source"))
    mine = left.select("event_id", "account_id", F.col("side").alias("source"), other.alias("other_source")).join(slim.drop("account_id", "source"), "event_id")
    sized = [F.abs("amount_minor").alias("_abs"), F.signum(F.col("amount_minor")).cast("int").alias("sign")]
    mine = mine.select("event_id", "account_id", "source", "other_source", "value_date", "description", *sized)
    pool = slim.where("account_id IS NOT NULL").select(F.col("source").alias("other_source"), "value_date", "event_id", "account_id", "description", *sized)
    # Askers take the offers of a day and sign from the front, leaving out those of their own account. So no one gets beyond as many offers
    # as it has rows around that day and its account has offers there; what comes later can reach no one and isn't walked.
    day, days = ["other_source", "_abs", "value_date"], max(same_days, opposite_days)
    around = F.explode(F.array(*[F.date_add("value_date", k) for k in range(-days, days + 1)])).alias("value_date")
    asked = mine.groupBy("account_id", "source", *day).agg(F.count(F.lit(1)).alias("n")).select("account_id", "source", "other_source", "_abs", around, "n")
    asked = asked.groupBy("account_id", "source", *day).agg(F.sum("n").alias("n")).groupBy(*day).agg(F.max("n").alias("asks"))
    owned = pool.groupBy(*day, "sign", "account_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*day, "sign").agg(F.max("n").alias("owned"))
    reach = owned.join(asked, day).select(*day, "sign", (F.col("owned") + F.col("asks")).alias("reach"))
    offers = _numbered(pool, [*day, "sign"]).join(reach, [*day, "sign"]).where("_place <= reach")
    keys = ["other_source", "_abs", "_run"]
    columns = ["value_date", "mine", "sign", "event_id", "account_id", "source", "description"]
    whole = mine.withColumn("mine", F.lit(True)).select(*keys[:-1], *columns).unionByName(offers.withColumns({"mine": F.lit(False), "source": F.lit(None).cast("string")}).select(*keys[:-1], *columns))
    placed = _runs(whole, keys[:-1], days).select(*keys, *columns)
    schema = "account_id string, source string, other_source string, event_id bigint, sibling_event_id bigint, sibling_account string, opposite_sign boolean"
    return in_order(placed, keys, ["value_date", "description", "event_id"], lambda key: _Slim(NearestOffer(key, same_days, opposite_days), 6), schema)


def destination_doubt(rows: DataFrame, attributed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sources of an account most of whose rows another source filed under other accounts: ``account_id, source, witness, file_rows,
    matched_elsewhere, likely_account``. Of several witnesses the one with the largest share speaks."""
    own = rows.groupBy("account_id", "source").agg(F.count(F.lit(1)).alias("file_rows"))
    by_home = attributed.where("sibling_event_id IS NOT NULL").groupBy("account_id", "source", "other_source", "sibling_account").agg(F.count(F.lit(1)).alias("n"))
    told = by_home.groupBy("account_id", "source", "other_source").agg(F.sum("n").alias("matched_elsewhere"), F.min_by("sibling_account", F.struct(-F.col("n"), "sibling_account")).alias("likely_account"))
    seen = told.join(own, ["account_id", "source"]).where(F.col("matched_elsewhere") >= threshold * F.col("file_rows"))
    best = seen.groupBy("account_id", "source").agg(F.min_by(F.struct("other_source", "file_rows", "matched_elsewhere", "likely_account"), F.struct(-F.col("matched_elsewhere"), "other_source")).alias("b"))
    return best.select("account_id", "source", F.col("b.other_source").alias("witness"), "b.file_rows", "b.matched_elsewhere", "b.likely_account")


class FirstOpposite:
    """Debits in order, each with the first free credit of another account within the window.

    Free credits are kept by day and, within a day, by account, so a debit looks at two accounts a day at most.
    """

    def __init__(self, key: tuple, days: int) -> None:
        self.days = days
        self.free: dict[date, dict[str | None, deque]] = {}
        self.waiting: deque = deque()

    def push(self, row: tuple) -> list[tuple]:
        day, account, credit, event = row
        out = self._serve(day)
        if credit:
            self.free.setdefault(day, {}).setdefault(account, deque()).append(event)
        else:
            self.waiting.append((day, account, event))
        return out

    def close(self) -> list[tuple]:
        return self._serve(None)

    def _serve(self, now: date | None) -> list[tuple]:
        out = []
        while self.waiting and (now is None or (now - self.waiting[0][0]).days > self.days):
            day, account, event = self.waiting.popleft()
            for old in [d for d in self.free if (day - d).days > self.days]:
                del self.free[old]
            for there in sorted(d for d in self.free if (d - day).days <= self.days):
                homes = self.free[there]
                home = next((h for h in homes if h != account), None)
                if home is not None:
                    out.append((event, homes[home].popleft()))
                    if not homes[home]:
                        del homes[home]
                    break
        return out


def transfer_pairs(ledger: DataFrame, days: int = 1) -> DataFrame:
    """Debits and credits of equal size in different accounts at most `days` apart, one to one: ``debit_event_id, credit_event_id``.

    In the order of day, account and arrival each debit takes the first free credit in the same order; zero amounts pair with nothing.
    """
    rows = ledger.where("amount_minor <> 0 AND value_date IS NOT NULL AND account_id IS NOT NULL").withColumn("_abs", F.abs("amount_minor"))
    # A size that only ever goes one way pairs with nothing and is not walked.
    placed = _runs(rows, ["_abs"], days)
    both = Window.partitionBy("_abs", "_run")
    live = placed.withColumn("_both", (F.min("amount_minor").over(both) < 0) & (F.max("amount_minor").over(both) > 0)).where("_both")
    live = live.select("_abs", "_run", "value_date", "account_id", (F.col("amount_minor") > 0).alias("credit"), "event_id", "arrival_seq")
    return in_order(live.select("_abs", "_run", "value_date", "account_id", "credit", "event_id", "arrival_seq"), ["_abs", "_run"], ["value_date", "account_id", "arrival_seq"], lambda key: _Slim(FirstOpposite(key, days), 4), "debit_event_id bigint, credit_event_id bigint")


class _Slim:
    """Drops what only ordered the rows."""

    def __init__(self, inner: FirstOpposite | NearestOffer, columns: int) -> None:
        self.inner, self.columns = inner, columns

    def push(self, row: tuple) -> list[tuple]:
        return self.inner.push(row[:self.columns])

    def close(self) -> list[tuple]:
        return self.inner.close()
