"""Asks of sources and what they covered: windows, bars, spans, timelines, due tiers, refusal trends and the walk back through history.

Edge cases: asks that name no window are points, never bars of invented width; null instants drop out; repeated asks count once where a
span is meant and each where asks are counted; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ask_window

# How many days a routine ask of these sources covered before windows were recorded.
ROUTINE_DAYS = {"truelayer-booked": 90, "truelayer-card-booked": 90, "starling-feed": 90}
# Days back of the tiers of overlapping asks, each with the hours after which it is due again.
TIERS = ((3, 0), (7, 24), (56, 24 * 7))
# Steps in days of a walk back through history, and the most calls of one walk.
STEPS, MOST_CALLS = (730, 365, 90, 30, 7, 1), 30


def asked_windows(asks: DataFrame, asked: str = "origin", at: str = "fetched_at") -> DataFrame:
    """The asks with ``asked_from, asked_to``, null where an ask names no window."""
    return asks.withColumn("_w", ask_window(F.col(asked), F.col(at))).select("*", F.col("_w.asked_from").alias("asked_from"), F.col("_w.asked_to").alias("asked_to")).drop("_w")


def asked_span(asks: DataFrame, open_ended: str = "starling-feed") -> DataFrame:
    """Per account how far back and forth it was asked and when the last payload landed.

    A feed asked without an end covers up to its fetch.
    """
    rows = asked_windows(asks)
    edge = F.coalesce("asked_to", F.when(F.col("source") == open_ended, F.to_date("fetched_at")))
    return rows.groupBy("account_ref").agg(F.min("asked_from").alias("earliest_asked"), F.max(edge).alias("latest_asked"), F.max("fetched_at").alias("last_landed"))


def attempts_ledger(artefacts: DataFrame) -> DataFrame:
    """Every ask with the first landing of its bytes and all names they landed under."""
    names = artefacts.where("origin IS NOT NULL").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))
    first = artefacts.groupBy("digest").agg(F.min("arrival_seq").alias("first_landing"))
    return artefacts.select("arrival_seq", "digest", "source", "fetched_at").join(first, "digest").join(names, "digest", "left")


def ask_bars(asks: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Asks as bars: ``ask_id, source, start_day, end_day, provenance, agrees``.

    The window recorded with an ask counts; else the one window that all names of its bytes tell (recovered); else the routine default
    (inferred); else the ask is a point. `agrees` says whether a recorded window is one of those its bytes landed under, null if they tell none.
    """
    told = asked_windows(artefacts.where("origin IS NOT NULL")).where("asked_from IS NOT NULL")
    told = told.groupBy("digest").agg(F.collect_set(F.struct("asked_from", "asked_to")).alias("told"))
    rows = asks.withColumn("own", ask_window(F.col("asked"), F.col("asked_at"))).join(told, "digest", "left")
    day = F.to_date("asked_at")
    days = F.lit(None).cast("int")
    for source, n in ROUTINE_DAYS.items():
        days = F.when(F.col("source") == source, n).otherwise(days)
    kind = (
        F.when(F.col("own").isNotNull(), "recorded").when(F.size("told") == 1, "recovered")
        .when(F.coalesce(F.size("told"), F.lit(0)).isin(0, -1) & days.isNotNull() & F.contains(F.col("asked"), F.lit("routine")), "inferred").otherwise("point")
    )
    window = F.when(kind == "recorded", F.col("own")).when(kind == "recovered", F.element_at("told", 1)).when(kind == "inferred", F.struct(F.date_sub(day, days).alias("asked_from"), day.alias("asked_to"))).otherwise(F.struct(day.alias("asked_from"), day.alias("asked_to")))
    agrees = F.when((kind == "recorded") & (F.size("told") > 0), F.array_contains("told", F.col("own")))
    return rows.where("asked_at IS NOT NULL").select("ask_id", "source", window["asked_from"].alias("start_day"), window["asked_to"].alias("end_day"), kind.alias("provenance"), agrees.alias("agrees"))


def extend_bounds(earliest: Column, days: int, today: Column) -> Column:
    """``struct<since, until>``: `days` back from the earliest held day with a day of overlap, never past today."""
    anchor = F.coalesce(earliest, today)
    return F.struct(F.date_sub(anchor, days).alias("since"), F.least(F.date_add(anchor, 1), today).alias("until"))


def timeline_segments(axes: DataFrame) -> DataFrame:
    """The axis of each account cut at its known days: ``account_id, position, kind, days``, equal neighbours as one.

    Input: ``account_id, axis_start, axis_end, earliest, latest, today, boundary, probed, covered``. By the middle of a piece: after today
    it is future; inside the held span held; asked without result empty; before a known boundary truncated; else unknown.
    """
    marks = F.array("boundary", "probed", "earliest", "latest", "covered", "today")
    inside = F.filter(marks, lambda d: d.isNotNull() & (d > F.col("axis_start")) & (d < F.col("axis_end")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("axis_start", "axis_end"), inside)))
    pieces = F.expr("transform(sequence(1, size(_cuts) - 1), i -> named_struct('a', _cuts[i - 1], 'b', _cuts[i]))")
    rows = axes.where("axis_end > axis_start").withColumn("_cuts", cuts).select("*", F.posexplode(pieces).alias("_i", "_p"))
    middle = F.date_add("_p.a", F.floor(F.datediff("_p.b", "_p.a") / 2).cast("int"))
    kind = (
        F.when(middle > F.col("today"), "future").when((middle >= F.col("earliest")) & (middle <= F.col("latest")), "held")
        .when((middle >= F.col("probed")) & (F.col("earliest").isNull() | (middle < F.col("earliest"))), "empty").when((middle > F.col("latest")) & (middle <= F.col("covered")), "empty")
        .when(middle < F.col("boundary"), "truncated").otherwise("unknown")
    )
    w = Window.partitionBy("account_id").orderBy("_i")
    placed = rows.select("account_id", "_i", kind.alias("kind"), F.datediff("_p.b", "_p.a").alias("days"))
    marked = placed.withColumn("position", F.sum(F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(0))).over(w))
    return marked.groupBy("account_id", "position", "kind").agg(F.sum("days").alias("days"))


def due_tiers(asks: DataFrame, now: Column, tiers: Sequence[tuple[int, int]] = TIERS) -> DataFrame:
    """Per connection the widest tier that is due: ``connection, days_back``. A tier is due when no landed ask at least as wide is younger than its hours."""
    width = F.datediff("asked_to", "asked_from")
    age = (now.cast("long") - F.col("fetched_at").cast("long")) / 3600
    fresh = [F.max(F.when((width >= days - 1) & (age < hours), 1).otherwise(0)).alias(f"_t{k}") for k, (days, hours) in enumerate(tiers)]
    per = asked_windows(asks).where("connection_id IS NOT NULL").groupBy(F.col("connection_id").alias("connection")).agg(*fresh)
    out = F.lit(None).cast("int")
    for k, (days, _) in enumerate(tiers):
        out = F.when(F.col(f"_t{k}") == 0, days).otherwise(out)
    return per.select("connection", out.alias("days_back"))


def spacing_gate(asks: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Per connection whether a scheduled ask may run: its last one lies at least `hours` back."""
    last = asks.where("connection_id IS NOT NULL").groupBy(F.col("connection_id").alias("connection")).agg(F.max("fetched_at").alias("last_asked"))
    return last.withColumn("may_run", (now.cast("long") - F.col("last_asked").cast("long")) >= hours * 3600)


def refusal_trends(asks: DataFrame, now: Column, least: int = 3, span_hours: int = 12, window_days: int = 3, min_asks: int = 6) -> DataFrame:
    """Per connection and account the highest rung that applies: ``connection, account, rung, refused, asks``.

    3: the newest asks are all refused, enough of them over a long enough span. 2 and 1: 80 % or half of the asks of the window refused.
    """
    w = Window.partitionBy("connection", "account").orderBy(F.desc("asked_at"), F.desc("ask_id"))
    ok = F.sum((~F.col("refused")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    recent = F.col("asked_at").cast("timestamp") >= now.cast("timestamp") - F.expr(f"INTERVAL {window_days} DAYS")
    dark = F.col("_ok") == 0
    seconds = F.unix_micros(F.col("asked_at").cast("timestamp"))
    per = asks.withColumn("_ok", ok).groupBy("connection", "account").agg(
        F.count_if(dark).alias("streak"), ((F.max(F.when(dark, seconds)) - F.min(F.when(dark, seconds))) / 3.6e9).alias("hours"), F.count_if(recent).alias("asks"), F.count_if(recent & F.col("refused")).alias("refused")
    )
    share = F.col("refused") / F.nullif("asks", F.lit(0))
    rung = F.when((F.col("streak") >= least) & (F.col("hours") >= span_hours), 3).when(F.col("asks") < min_asks, 0).when(share >= 0.8, 2).when(share >= 0.5, 1).otherwise(0)
    return per.select("connection", "account", rung.alias("rung"), "refused", "asks").where("rung > 0")


def amendment_cutoffs(items: DataFrame, k: int = 4) -> DataFrame:
    """Items whose content changed after their first sighting, newest first: ``uid, cutoff, changed_at``; the report shows `k`.

    Input: ``uid, rendered, happened, updated, fetched_at, arrival_seq``. The cutoff lies a minute before the change, else half way to it.
    """
    w = Window.partitionBy("uid").orderBy("fetched_at", "arrival_seq")
    seen = items.withColumn("_before", F.lag("rendered").over(w)).withColumn("_first", F.first("happened", ignorenulls=True).over(w))
    changed = seen.where("_before IS NOT NULL AND _before <> rendered").withColumn("changed_at", F.coalesce("updated", "fetched_at")).where("changed_at > _first")
    last = changed.groupBy("uid").agg(F.max_by(F.struct("changed_at", "_first"), F.struct("fetched_at", "arrival_seq")).alias("c"))
    minute = F.col("c.changed_at") - F.expr("INTERVAL 1 MINUTE")
    half = F.timestamp_micros(((F.unix_micros("c._first") + F.unix_micros("c.changed_at")) / 2).cast("long"))
    return last.select("uid", F.when(minute > F.col("c._first"), minute).otherwise(half).alias("cutoff"), F.col("c.changed_at").alias("changed_at")).orderBy(F.desc("changed_at"), "uid").limit(k)


def walk_history(ask: Callable[[date, date], str], start: date, oldest: date, steps: Sequence[int] = STEPS, most: int = MOST_CALLS) -> tuple[str, date, int]:
    """Walk back through one account's history: outcome, how far it reached, calls made.

    `ask(since, until)` answers ``landed``, ``too_far``, ``sca_expired``, ``rate_limited`` or ``refused``. A window that reaches too far is
    tried smaller; the smallest that still does marks the boundary. This talks to a source, so it runs on the driver.
    """
    reached, size, calls = start, 0, 0
    while calls < most:
        if reached <= oldest:
            return "complete", reached, calls
        since = max(oldest, reached - timedelta(days=steps[size]))
        calls += 1
        answer = ask(since, reached)
        if answer == "landed":
            reached = since
        elif answer == "too_far" and size + 1 < len(steps):
            size += 1
        else:
            return ("boundary" if answer == "too_far" else answer), reached, calls
    return "cap", reached, calls


def progress(started: Column, now: Column, done: Column, total: Column) -> Column:
    """``struct<per_minute, minutes_left>`` of a running job; null before half a minute has passed."""
    seconds = now.cast("double") - started.cast("double")
    rate = done / seconds * 60
    return F.when((seconds > 30) & (done > 0), F.struct(rate.alias("per_minute"), ((total - done) / rate).alias("minutes_left")))
