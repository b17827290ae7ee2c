"""History of changing facts: a bitemporal ledger of readings and the versions that it currently believes.

Each reading starts on a valid day and is recorded at an instant. A later record of the same valid day that ranks higher, or a
record that falls into the period of an earlier one, ends what was believed without overwriting it: ledger rows carry both a valid
period and a recorded period, and the rows whose recorded period is open are the present belief.

Edge cases: rows whose value is null, blank or '-' and rows without any start are left out; null keys form their own series; repeated
rows count once; an unknown or null provenance ranks as a statement; ties go to the larger observation_id; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("account_id", "fact", "kind")
VERSIONED = ("rate", "limit", "name", "standing")

# Stand for "before all instants" (negative) or "no end", and for "no last day".
FAR = 1 << 62
FAR_DAY = (1 << 31) - 1


def provenance_rank(provenance: Column) -> Column:
    """human 2, model 1, everything else 0."""
    return F.when(F.lower(provenance).startswith("human"), 2).when(F.lower(provenance).startswith("model"), 1).otherwise(0)


def plain_value(value: Column) -> Column:
    """A value without notation: blanks, letter case, currency and percent signs dropped, numbers in one form."""
    squeezed = F.lower(F.regexp_replace(value, r"[\s\x{00A0}]+", ""))
    number = F.regexp_extract(squeezed, r"^(?:gbp|eur|usd|[£€$])?(-?[0-9][0-9,]*(?:\.[0-9]+)?)(?:gbp|eur|usd|[£€$])?%?(?:p\.?a\.?)?$", 1)
    decimal = F.regexp_replace(number, ",", "").try_cast("decimal(30,6)").cast("string")
    return F.when(number != "", F.coalesce(decimal, squeezed)).otherwise(squeezed)


def readings(observations: DataFrame, facts: Sequence[str] = VERSIONED) -> DataFrame:
    """Usable readings with their start, rank and plain value; one row per observation_id."""
    value = F.trim(F.col("value"))
    return (
        observations.where(F.col("fact").isin(*facts))
        .where(F.col("value").isNotNull() & (F.regexp_replace(value, r"[\s\x{00A0}]+", "") != "") & (value != "-"))
        .select(
            *KEYS,
            F.coalesce("window_from", "observed_at").alias("start"),
            "window_to",
            "observed_at",
            "observation_id",
            "ingested_at",
            provenance_rank(F.col("provenance")).alias("rank"),
            plain_value(F.col("value")).alias("plain"),
        )
        .where("start IS NOT NULL")
        .distinct()
    )


def reading_periods(rows: DataFrame) -> DataFrame:
    """Every reading once, with the period it was believed in and the end that present beliefs give it.

    ``recorded_to`` is the instant at which a better reading of the same day arrived (null: still believed). ``valid_to`` is the day
    before the next reading that is believed now, found by a sweep over starts; null when none follows. What was believed of other
    days before they were corrected is not here but in :func:`bitemporal_ledger`.
    """
    day = Window.partitionBy(*KEYS, "start")
    better = F.struct("rank", "observed_at", "observation_id")
    # Within one valid day belief only moves upward: a reading ends when the first better one is recorded.
    arrived = day.orderBy("ingested_at", "observation_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("_better", better).withColumn("_held", F.max("_better").over(arrived))
    kept = kept.where(F.col("_held").isNull() | (F.col("_held") < F.col("_better")))
    recorded = kept.withColumn("recorded_to", F.lead("ingested_at").over(day.orderBy("ingested_at", "observation_id")))
    recorded = recorded.withColumnRenamed("ingested_at", "recorded_from").drop("_better", "_held")
    placed = recorded.withColumn("_day", F.datediff("start", F.lit("1970-01-01")))
    # From the last start back: the frame only grows, so a hot series costs one pass.
    sweep = Window.partitionBy(*KEYS).orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, -1)
    following = F.min(F.when(F.col("recorded_to").isNull(), F.col("start"))).over(sweep)
    return placed.withColumn("valid_to", F.date_sub(following, 1)).withColumnRenamed("start", "valid_from").drop("_day")


def _slices(table: pa.Table) -> pa.Table:
    """The ledger rows of one series: a sweep from the last start back, with a stack of the starts that can follow.

    The stack holds the nearest following start first and, after it, only starts known earlier than all nearer ones. Each start's first
    arrival cuts one earlier slice, so there are at most as many rows as readings and starts together.
    """
    held: dict[int, list[tuple[int, int, int, int]]] = {}
    for row, (day, since, until, window) in enumerate(zip(*(table[c].to_pylist() for c in ("_day", "_since", "_until", "_window")))):
        held.setdefault(day, []).append((since, until, window, row))
    out: list[tuple[int, int, int, int]] = []
    following: list[tuple[int, int]] = []
    for day in sorted(held, reverse=True):
        for since, until, window, row in sorted(held[day]):
            pieces, upto = [], until
            for first, start in reversed(following):
                if first < upto:
                    pieces.append((row, min(start - 1, window), max(first, since), upto))
                    upto = first
                if first <= since:
                    break
            if upto > since:
                pieces.append((row, window, since, upto))
            for piece in reversed(pieces):
                if out and out[-1][:2] == piece[:2]:
                    out[-1] = (*out[-1][:3], piece[3])
                else:
                    out.append(piece)
        first = min(x[0] for x in held[day])
        while following and following[-1][0] >= first:
            following.pop()
        following.append((first, day))
    rows, ends, since, until = map(list, zip(*out))
    taken = table.drop_columns(["_day", "_since", "_until", "_window"]).take(pa.array(rows, pa.int64()))
    for name, values, kind, none in (("_valid_to", ends, pa.int32(), FAR_DAY), ("_from", since, pa.int64(), -FAR), ("_to", until, pa.int64(), FAR)):
        taken = taken.append_column(name, pa.array([None if x == none else x for x in values], kind))
    return taken


def bitemporal_ledger(rows: DataFrame) -> DataFrame:
    """Every slice of belief: which reading was valid in which days, and from which to which instant that was believed.

    A reading is valid up to the day before the next start known at that instant, or up to its ``window_to`` if that is earlier (null:
    no end; a window that ends before it begins leaves a slice without days). Each instant that changes this ends the recorded period
    of the slice and adds a new one: a late reading splits the earlier reading that it falls into, a better one of the same day takes
    the day over. At every instant the slices with ``recorded_from <= instant < recorded_to`` (null: before all, still believed) are
    what was believed then. Of readings recorded at one instant only the best of a day was ever believed.

    Columns: the keys, ``observation_id, plain, window_to, valid_from, valid_to, recorded_from, recorded_to``.
    """
    better = F.struct("rank", "observed_at", "observation_id")
    instant = F.coalesce(F.unix_micros("ingested_at"), F.lit(-FAR))
    best = F.max_by(F.struct("observation_id", "plain", "window_to"), better)
    told = rows.groupBy(*KEYS, "start", instant.alias("_since")).agg(F.max(better).alias("_better"), best.alias("_told"))
    # Within one valid day belief only moves upward: a reading ends when the first better one is recorded.
    day = Window.partitionBy(*KEYS, "start").orderBy("_since")
    told = told.withColumn("_held", F.max("_better").over(day.rowsBetween(Window.unboundedPreceding, -1)))
    kept = told.where(F.col("_held").isNull() | (F.col("_held") < F.col("_better")))
    kept = kept.select(
        *KEYS,
        "_told.*",
        F.col("start").alias("valid_from"),
        F.unix_date("start").alias("_day"),
        "_since",
        F.coalesce(F.lead("_since").over(day), F.lit(FAR)).alias("_until"),
        F.coalesce(F.unix_date("window_to"), F.lit(FAR_DAY)).alias("_window"),
    )
    kinds = dict(kept.dtypes)
    names = [*KEYS, "observation_id", "plain", "window_to", "valid_from"]
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + ["_valid_to int", "_from bigint", "_to bigint"])
    split = kept.groupBy(*KEYS).applyInArrow(_slices, schema)
    return split.select(
        *names,
        F.date_from_unix_date("_valid_to").alias("valid_to"),
        F.timestamp_micros("_from").alias("recorded_from"),
        F.timestamp_micros("_to").alias("recorded_to"),
    )


def as_of(ledger: DataFrame, day: Column, instant: Column) -> DataFrame:
    """What was believed at `instant` about `day`: the ledger's slices whose valid and recorded periods hold both."""
    valid = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
    recorded = (F.col("recorded_from").isNull() | (F.col("recorded_from") <= instant)) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > instant))
    return ledger.where(valid & recorded)


def versions(rows: DataFrame) -> DataFrame:
    """Each version with the days it was valid: ``account_id, fact, kind, valid_from, valid_to`` as strings, '' for no end.

    Versions are runs of the ledger's open slice, which has one row a start day, so the windows over a series are bounded by the calendar.
    """
    held = bitemporal_ledger(rows).where("recorded_to IS NULL")
    w = Window.partitionBy(*KEYS).orderBy("valid_from")
    broken = (
        F.lag("plain").over(w).isNull()
        | (F.lag("plain").over(w) != F.col("plain"))
        | F.coalesce(F.lag("valid_to").over(w) < F.date_sub("valid_from", 1), F.lit(False))
    )
    first = held.withColumn("_new", broken.cast("int")).withColumn("_version", F.sum("_new").over(w))
    spans = first.groupBy(*KEYS, "_version").agg(F.min("valid_from").alias("_from"), F.max_by("valid_to", "valid_from").alias("_to"))
    return spans.select(*KEYS, F.col("_from").cast("string").alias("valid_from"), F.coalesce(F.col("_to").cast("string"), F.lit("")).alias("valid_to"))
