"""Ledger operators: canonical projection, identity, coverage, matching, walks and audits, as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_key, entity_id


def project_events(events: DataFrame) -> DataFrame:
    """The canonical ledger over the event stream: coarse amounts and few descriptions, so that rows collide."""
    kind = F.pmod("event_id", F.lit(3))
    sign = F.when(F.col("event_type").isin("purchase", "view", "error"), -1).otherwise(1)
    return events.select(
        "event_id",
        F.concat(F.lit("acct-"), F.pmod("user_id", F.lit(97))).alias("account_id"),
        F.when(kind == 0, "starling").when(kind == 1, "truelayer").otherwise("qif").alias("source"),
        F.when(kind == 2, "synthetic").otherwise("authoritative").alias("tier"),
        F.when(kind != 2, F.concat(F.lit("id-"), "event_id")).alias("source_id"),
        (F.floor(F.col("value") / 10).cast("long") * 1000 * sign).alias("amount_minor"),
        F.to_date("ts").alias("value_date"),
        F.concat(F.upper("event_type"), F.lit(" "), F.pmod("event_id", F.lit(4))).alias("description"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, "pending").otherwise("booked").alias("status"),
        F.col("event_id").alias("arrival_seq"),
        F.sha2(F.concat(F.lit("batch-"), F.floor(F.col("event_id") / 50).cast("string")), 256).alias("artefact_digest"),
    )


# --- scalars -------------------------------------------------------------------------------------------------------------------


def group_key(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, r"[0-9*#]+", ""), r"\s+", " ")))


def reference_coded(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.nullif(F.length(text), F.lit(0)) > 0.5, F.lit(False))


def could_be_one_payment(a: str, b: str, same_content: Column) -> Column:
    """The decision ladder on two observations given by their column prefixes."""
    c = lambda side, name: F.col(f"{side}{name}")
    manual_a, manual_b = c(a, "tier") == "manual", c(b, "tier") == "manual"
    return (
        F.when(manual_a & manual_b, False)
        .when(manual_a | manual_b, True)
        .when(c(a, "source") != c(b, "source"), True)
        .when((c(a, "status") == "pending") != (c(b, "status") == "pending"), True)
        .when((c(a, "tier") == "authoritative") & (c(b, "tier") == "authoritative") & c(a, "source_id").isNotNull() & c(b, "source_id").isNotNull(), c(a, "source_id") == c(b, "source_id"))
        .when(~same_content, False)
        .otherwise(c(a, "occurrence") == c(b, "occurrence"))
    )


# --- keys and numbering --------------------------------------------------------------------------------------------------------


def with_keys(ledger: DataFrame) -> DataFrame:
    """Content key and occurrence number (equal content of an account within one artefact, in its order, from 0)."""
    keyed = ledger.withColumn("content_key", content_key(F.col("amount_minor"), F.col("value_date"), F.col("description")))
    w = Window.partitionBy("artefact_digest", "account_id", "content_key").orderBy("arrival_seq")
    return keyed.withColumn("occurrence", F.row_number().over(w) - 1)


def entity_ids(keyed: DataFrame) -> DataFrame:
    cols = ("account_id", "source", "source_id", "content_key", "occurrence", "artefact_digest")
    return keyed.select("event_id", entity_id(*map(F.col, cols)).alias("entity_id"))


# --- coverage and agreement ----------------------------------------------------------------------------------------------------


def coverage(ledger: DataFrame, keys: tuple[str, ...] = ("account_id", "source")) -> DataFrame:
    amount = F.col("amount_minor")
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value_date").alias("first_date"),
        F.max("value_date").alias("last_date"),
        F.sum(F.when(amount > 0, amount).otherwise(0)).alias("inflow"),
        F.sum(F.when(amount < 0, amount).otherwise(0)).alias("outflow"),
        F.sum(amount).alias("net"),
        F.count("source_id").alias("durable_ids"),
    )


def agreement(ledger: DataFrame) -> DataFrame:
    """Per account and pair of sources: counts and nets inside the overlap of both, from daily sums instead of row pairs."""
    daily = ledger.groupBy("account_id", "source", "value_date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("net"))
    spans = daily.groupBy("account_id", "source").agg(F.min("value_date").alias("a"), F.max("value_date").alias("b"))
    left = spans.select("account_id", F.col("source").alias("left_source"), F.col("a").alias("la"), F.col("b").alias("lb"))
    right = spans.select("account_id", F.col("source").alias("right_source"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    pairs = left.join(right, "account_id").where("left_source < right_source").select("account_id", "left_source", "right_source", F.greatest("la", "ra").alias("overlap_from"), F.least("lb", "rb").alias("overlap_to")).where("overlap_from <= overlap_to")
    # Every pair meets the days of its two sources only: an equi join on the account with few rows a day and source.
    inside = pairs.join(daily, "account_id").where("value_date BETWEEN overlap_from AND overlap_to AND source IN (left_source, right_source)")
    side = lambda s, v: F.sum(F.when(F.col("source") == F.col(s), F.col(v)).otherwise(0))
    out = inside.groupBy("account_id", "left_source", "right_source", "overlap_from", "overlap_to").agg(
        side("left_source", "n").alias("left_n"), side("right_source", "n").alias("right_n"), side("left_source", "net").alias("left_net"), side("right_source", "net").alias("right_net")
    )
    return out.withColumn("agrees", (F.col("left_n") == F.col("right_n")) & (F.col("left_net") == F.col("right_net")))


def month_gaps(rows: DataFrame) -> DataFrame:
    """Months strictly between a series' first and last that hold nothing: ``account_id, source, month``."""
    months = rows.select("account_id", "source", F.trunc("value_date", "month").alias("month")).distinct()
    after = F.lead("month").over(Window.partitionBy("account_id", "source").orderBy("month"))
    holes = months.withColumn("_after", after).where(F.add_months("month", 1) < F.col("_after"))
    return holes.select("account_id", "source", F.explode(F.sequence(F.add_months("month", 1), F.add_months("_after", -1), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def gap_witnesses(rows: DataFrame) -> DataFrame:
    """The missing months with how many other sources of the account do have rows in them."""
    held = rows.select("account_id", F.col("source").alias("witness"), F.trunc("value_date", "month").alias("month")).distinct()
    return month_gaps(rows).join(held, ["account_id", "month"], "left").groupBy("account_id", "source", "month").agg(F.count_distinct("witness").alias("witnesses"))


def transpositions(rows: DataFrame) -> DataFrame:
    """Equal account, amount and description in two sources with day and month exchanged, unless both sources hold both days."""
    swapped = F.when(F.dayofmonth("value_date") <= 12, F.make_date(F.year("value_date"), F.dayofmonth("value_date"), F.least(F.month("value_date"), F.lit(28))))
    held = rows.select("account_id", "amount_minor", "description", "source", "value_date").distinct()
    a = rows.select("account_id", "amount_minor", "description", F.col("source").alias("left_source"), F.col("value_date").alias("left_date"), swapped.alias("right_date")).where("right_date IS NOT NULL AND right_date <> left_date")
    b = rows.select("account_id", "amount_minor", "description", F.col("source").alias("right_source"), F.col("value_date").alias("right_date"))
    found = a.join(b, ["account_id", "amount_minor", "description", "right_date"]).where("left_source < right_source").select("account_id", "amount_minor", "description", "left_source", "right_source", "left_date", "right_date").distinct()
    key = ["account_id", "amount_minor", "description"]
    also = lambda source, day, name: held.select(*key, F.col("source").alias(source), F.col("value_date").alias(day), F.lit(True).alias(name))
    both = found.join(also("left_source", "right_date", "_l"), [*key, "left_source", "right_date"], "left").join(also("right_source", "left_date", "_r"), [*key, "right_source", "left_date"], "left")
    return both.where("_l IS NULL OR _r IS NULL").select(*found.columns)


def stale_feeds(rows: DataFrame, lag: int = 3) -> DataFrame:
    """Sources of an account whose last row is more than `lag` days older than the freshest other source's."""
    last = rows.groupBy("account_id", "source").agg(F.max("value_date").alias("last_date"))
    top = last.groupBy("account_id").agg(F.max(F.struct("last_date", "source")).alias("w"))
    return last.join(top, "account_id").where(f"w.source <> source AND datediff(w.last_date, last_date) > {lag}").select(
        "account_id", "source", "last_date", F.col("w.source").alias("witness"), F.datediff("w.last_date", "last_date").alias("days_behind")
    )


# --- sightings -----------------------------------------------------------------------------------------------------------------


def sightings(ledger: DataFrame) -> DataFrame:
    """Each row as seen by its own source, and every second row by a statement too."""
    own = ledger.select("event_id", "account_id", "source", "value_date", "amount_minor")
    return own.unionByName(own.where("event_id % 2 = 0").withColumn("source", F.lit("statement")))


def source_counts(seen: DataFrame) -> DataFrame:
    return seen.groupBy("account_id").agg(F.count_distinct("source").alias("sources"))


def corroboration(seen: DataFrame) -> DataFrame:
    each = seen.groupBy("account_id", "event_id").agg(F.count_distinct("source").alias("k"))
    return each.groupBy("account_id").agg(F.count_if(F.col("k") > 1).alias("corroborated"), F.count_if(F.col("k") == 1).alias("single_source"))


# --- matching ------------------------------------------------------------------------------------------------------------------


def _sides(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ("event_id", "source", "tier", "source_id", "status", "content_key", "occurrence", "value_date", "arrival_seq")
    side = lambda p: keyed.select("account_id", "amount_minor", *[F.col(c).alias(p + c) for c in cols])
    return side("a_"), side("b_")


def content_match(keyed: DataFrame) -> DataFrame:
    """For each row the earliest row of equal content that may be the same payment.

    What the ladder asks of two rows depends only on their tier, source, status, id and occurrence. Rows of equal content collapse to these
    classes with their first and second arrival, and rows meet classes, so a group of n equal rows never becomes n * n pairs.
    """
    cls = ("source", "tier", "source_id", "status", "occurrence")
    held = keyed.withColumn("status", F.when(F.col("status") == "pending", "pending").otherwise("other"))
    classes = held.groupBy("account_id", "content_key", *cls).agg(F.min(F.struct("arrival_seq", "event_id")).alias("first"))
    a, b = (classes.select("account_id", "content_key", F.struct(*cls).alias(f"{p}cls"), *[F.col(c).alias(p + c) for c in cls], F.col("first").alias(p + "first")) for p in ("a_", "b_"))
    # Classes that agree in all but the id of a payment fed many times stay few per content: a class is met once by every other class.
    met = a.join(b, ["account_id", "content_key"]).where(could_be_one_payment("a_", "b_", F.lit(True))).groupBy("account_id", "content_key", "a_cls").agg(F.min("b_first").alias("match"))
    rows = held.select("account_id", "content_key", F.struct(*cls).alias("a_cls"), "event_id", "arrival_seq")
    same = (F.col("r.account_id") == F.col("m.account_id")) & (F.col("r.content_key") == F.col("m.content_key")) & F.col("r.a_cls").eqNullSafe(F.col("m.a_cls"))
    hits = rows.alias("r").join(met.alias("m"), same).where(F.col("m.match.arrival_seq") < F.col("r.arrival_seq"))
    return hits.select("r.event_id", F.col("m.match.event_id").alias("match_id"))


def nearest_fuzzy_match(keyed: DataFrame, days: int = 7) -> DataFrame:
    """For each row the nearest earlier-arrived row of equal account and amount within the window, by date then arrival.

    Candidates meet in buckets of `days`; a row looks into its own and both neighbours, so a hot amount never meets all of itself.
    """
    a, b = _sides(keyed)
    bucket = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    a = a.withColumn("_k", F.explode(F.array(bucket("a_value_date") - 1, bucket("a_value_date"), bucket("a_value_date") + 1)))
    b = b.withColumn("_k", bucket("b_value_date"))
    hits = a.join(b, ["account_id", "amount_minor", "_k"]).where(f"b_arrival_seq < a_arrival_seq AND abs(datediff(a_value_date, b_value_date)) <= {days} AND a_content_key <> b_content_key")
    ok = hits.where(could_be_one_payment("a_", "b_", F.lit(False)))
    return ok.groupBy(F.col("a_event_id").alias("event_id")).agg(F.min(F.struct(F.abs(F.datediff("a_value_date", "b_value_date")).alias("days"), F.col("b_event_id").alias("match_id"))).alias("m")).select("event_id", "m.match_id", "m.days")


def recurring_series(rows: DataFrame) -> DataFrame:
    """Rows that continue a series: the gaps to the last two equal (amount, description) rows differ by at most a day."""
    w = Window.partitionBy("account_id", "amount_minor", "description").orderBy("value_date")
    day = rows.select("account_id", "amount_minor", "description", "value_date").distinct()
    two = day.withColumn("p1", F.lag("value_date", 1).over(w)).withColumn("p2", F.lag("value_date", 2).over(w))
    return two.where("p2 IS NOT NULL AND abs(datediff(value_date, p1) - datediff(p1, p2)) <= 1").select("account_id", "amount_minor", "description", "value_date")


# --- walks, lags, profiles -----------------------------------------------------------------------------------------------------


def balance_walk(lines: DataFrame) -> DataFrame:
    """Between two known balances the amounts in between must explain the step; a known balance closes its island."""
    w = Window.partitionBy("account_id").orderBy("pos")
    island = F.coalesce(F.count("balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    isles = lines.withColumn("island", island).groupBy("account_id", "island").agg(F.sum("amount_minor").alias("moved"), F.max("balance").alias("balance"))
    before = F.lag("balance").over(Window.partitionBy("account_id").orderBy("island"))
    return isles.withColumn("before", before).where("before IS NOT NULL AND balance IS NOT NULL").select("account_id", "island", (F.col("before") + F.col("moved") == F.col("balance")).alias("holds"))


def settlement_lag(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    bucket = F.when(days <= 0, "same-day").when(days == 1, "1d").when(days == 2, "2d").when(days == 3, "3d").otherwise("4d+")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def duplication(rows: DataFrame) -> DataFrame:
    """Per source: records, distinct bytes and redundancy, with a total row."""
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("digest").alias("distinct_bytes")).select(
        F.coalesce("source", F.lit("TOTAL")).alias("source"), "records", "distinct_bytes", (F.col("records") - F.col("distinct_bytes")).alias("redundant")
    )


def worklist(ledger: DataFrame, k: int = 20) -> DataFrame:
    """The largest groups of like descriptions (the report shows `k`)."""
    n = F.count(F.lit(1))
    groups = ledger.withColumn("label", group_key(F.col("description"))).groupBy("label").agg(
        n.alias("members"), F.min_by("description", "arrival_seq").alias("example"), F.count_distinct("description").alias("distinct_descriptions")
    )
    repeating = (F.col("members") >= 3) & (F.col("distinct_descriptions") <= F.greatest(F.lit(2), F.floor(F.col("members") / 10)))
    return groups.withColumn("repeating", repeating).withColumn("reference_coded", reference_coded(F.col("example"))).orderBy(F.desc("members"), "label").limit(k)


def explain(ledger: DataFrame) -> DataFrame:
    """Per description: size, reach, most usual amount (first by date among equals) and the upper median gap.

    Gaps are counted by length before the median is taken, so a description with a third of all rows gathers no list of them.
    """
    w = Window.partitionBy("description").orderBy("value_date", "arrival_seq")
    gap = F.datediff("value_date", F.lag("value_date").over(w))
    base = ledger.groupBy("description").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("accounts"), F.min("amount_minor").alias("low"), F.max("amount_minor").alias("high"), F.min("value_date").alias("first_date"), F.max("value_date").alias("last_date"),
    )
    modes = ledger.groupBy("description", "amount_minor").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("value_date", "arrival_seq")).alias("f"))
    first = Window.partitionBy("description").orderBy(F.desc("c"), "f")
    mode = modes.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("description", F.col("amount_minor").alias("usual_amount"))
    gaps = ledger.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("description", "gap").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("description").orderBy("gap")
    middle = gaps.withColumn("_upto", F.sum("c").over(upto)).withColumn("_all", F.sum("c").over(Window.partitionBy("description"))).where("_upto > _all div 2").groupBy("description").agg(F.min("gap").alias("typical_gap"))
    return base.join(mode, "description").join(middle, "description", "left")


#: Rules up to which one projection holds them all as literals; beyond, texts meet rules in a join.
RULES_BOUND = 5_000


def first_match_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule in file order whose needle a text contains; rules with an empty value are passed over: ``id, category, rule_no``."""
    usable = rules.where("value <> '' AND needle IS NOT NULL").select("rule_no", F.lower("needle").alias("needle"), "value").orderBy("rule_no")
    held = usable.limit(RULES_BOUND + 1).collect()
    if len(held) > RULES_BOUND:
        hits = parts.join(usable, F.contains(F.lower(F.col("text")), F.col("needle")), "left")
        return hits.groupBy("id").agg(F.min_by("value", "rule_no").alias("category"), F.min("rule_no").alias("rule_no"))
    if not held:
        return parts.select("id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("rule_no"))
    lines = F.array(*[F.struct(F.lit(r.rule_no).cast("int").alias("rule_no"), F.lit(r.needle).alias("needle"), F.lit(r.value).alias("value")) for r in held])
    low = F.lower(F.col("text"))
    first = F.get(F.filter(lines, lambda r: F.contains(low, r["needle"])), F.lit(0))
    return parts.select("id", first["value"].alias("category"), first["rule_no"].alias("rule_no"))


def annotation_winner(log: DataFrame) -> DataFrame:
    """The write that stands: the last of the highest rank."""
    return log.groupBy("entity_id", "kind").agg(F.max_by("value", F.struct("rank", "seq")).alias("value"), F.max("rank").alias("rank"))


def refusal_streaks(asks: DataFrame) -> DataFrame:
    """Per connection the trailing run of refusals."""
    w = Window.partitionBy("connection").orderBy(F.desc("asked_at"), F.desc("ask_id"))
    run = F.sum((~F.col("refused")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return asks.withColumn("_ok", run).groupBy("connection").agg(F.count_if(F.col("_ok") == 0).alias("streak"), F.count(F.lit(1)).alias("asks"))


def audit_partition(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every identifier as present, diverged, missing, orphaned or duplicated, from one full outer join."""
    mine = expected.groupBy("imported_id").agg(F.count(F.lit(1)).alias("e_n"), F.sum("amount_minor").alias("e_amount"))
    there = actual.groupBy("imported_id").agg(F.count(F.lit(1)).alias("a_n"), F.sum("amount_minor").alias("a_amount"))
    state = (
        F.when(F.col("a_n") > 1, "duplicated").when(F.col("a_n").isNull(), "missing").when(F.col("e_n").isNull(), "orphaned").when(F.col("e_amount") != F.col("a_amount"), "diverged").otherwise("present")
    )
    return mine.join(there, "imported_id", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def id_match(keyed: DataFrame) -> DataFrame:
    """Rows of a source with an equal durable id in one account; the earliest is what the others match."""
    with_id = keyed.where("source_id IS NOT NULL")
    first = with_id.groupBy("account_id", "source", "source_id").agg(F.min("arrival_seq").alias("match_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return with_id.join(first, ["account_id", "source", "source_id"]).where("arrival_seq > match_id").select("event_id", "match_id")


def source_connections(transactions: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Connections that brought rows of an account; digests are made distinct before the join, so rows do not fan out."""
    named = artefacts.where("connection_id IS NOT NULL AND connection_id <> ''").select(F.col("digest").alias("artefact_digest"), "connection_id").distinct()
    seen = transactions.select("account_id", "source", "artefact_digest").distinct()
    return seen.join(named, "artefact_digest").select("account_id", "source", "connection_id").distinct()


def walk_convention(lines: DataFrame) -> DataFrame:
    """Which of four readings explains most steps of an account: balances up or down the page, amounts as signed or flipped."""
    w = Window.partitionBy("account_id").orderBy("pos")
    step = F.col("balance") - F.lag("balance").over(w)
    seen = lines.withColumn("step", step).withColumn("before", F.lag("amount_minor").over(w)).where("step IS NOT NULL")
    votes = {"forward": F.col("step") == F.col("amount_minor"), "forward_flipped": F.col("step") == -F.col("amount_minor"), "backward": F.col("step") == -F.col("before"), "backward_flipped": F.col("step") == F.col("before")}
    counted = seen.groupBy("account_id").agg(*[F.count_if(v).alias(k) for k, v in votes.items()], F.count(F.lit(1)).alias("steps"))
    best = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(votes)])
    return counted.select("account_id", "steps", best["n"].alias("explained"), best["name"].alias("convention"))


def shape_summary(rows: DataFrame, columns: list[str], digits: int = 10) -> DataFrame:
    """Per column: presence, distinct values, smallest and largest text, lengths; values only where at most `digits` differ."""
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])))
    shape = cells.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"),
    )
    return shape.withColumn("categorical", F.col("distinct_values") <= digits)


def presence_links(rows: DataFrame, category: str, field: str, least: int = 5) -> DataFrame:
    """Categories in which a partly present field is there always or never."""
    seen = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count(field).alias("present"))
    return seen.where(f"n >= {least} AND present IN (0, n)").select("category", "n", (F.col("present") > 0).alias("always"))


def dead_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits per rule, rules without any included."""
    hit = first_match_rules(parts, rules).where("rule_no IS NOT NULL").groupBy("rule_no").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(hit, "rule_no", "left").select("rule_no", "needle", F.coalesce("n", F.lit(0)).alias("hits"))


def alert_edges(before: DataFrame, now: DataFrame) -> DataFrame:
    """What to announce between two states of (key, rung): new or higher rungs announce, lower ones are silent, vanished ones resolve."""
    both = before.withColumnRenamed("rung", "old").join(now.withColumnRenamed("rung", "new"), "key", "full")
    edge = F.when(F.col("new").isNull(), "resolved").when(F.col("old").isNull() | (F.col("new") > F.col("old")), "announced").otherwise("silent")
    return both.select("key", edge.alias("edge"))


def rebuild_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts per account before and after, with what vanished or is new."""
    b, a = before.groupBy("account_id").agg(F.count(F.lit(1)).alias("b")), after.groupBy("account_id").agg(F.count(F.lit(1)).alias("a"))
    state = F.when(F.col("a").isNull(), "vanished").when(F.col("b").isNull(), "new").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return b.join(a, "account_id", "full").select("account_id", F.coalesce("b", F.lit(0)).alias("rows_before"), F.coalesce("a", F.lit(0)).alias("rows_after"), state.alias("state"))


def orphan_rows(rows: DataFrame, key: str, owners: DataFrame, owner_key: str) -> DataFrame:
    """Rows whose reference names no owner; null and empty references are no orphans."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).join(owners.select(F.col(owner_key).alias(key)).distinct(), key, "left_anti")


def budget_payload(ledger: DataFrame) -> DataFrame:
    """Rows as a budgeting application takes them: stable imported id, payee, cleared flag; void rows stay out."""
    keyed = with_keys(ledger.where("status <> 'void'"))
    return keyed.select("event_id", "account_id", F.concat("content_key", F.lit(":"), F.col("occurrence").cast("string")).alias("imported_id"), F.col("description").alias("payee"), "amount_minor", (F.col("status") != "pending").alias("cleared"))


def duplicate_ids(payload: DataFrame) -> DataFrame:
    return payload.groupBy("account_id", "imported_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def propagation(rows: DataFrame) -> DataFrame:
    """Categories that labelled rows lend to unlabelled ones of the same group within ten per cent of the amount: one value is a target,
    several are contested. Labelled rows collapse to (group, value, amount), and both sides meet in buckets of the logarithm of the amount,
    so a usual group does not meet all of itself."""
    step = 0.1
    bucket = lambda c, by=1.0: F.floor(F.log(F.greatest(F.abs(F.col(c)), F.lit(1)) * F.lit(by)) / F.lit(step)).cast("int")
    seeds = rows.where("label IS NOT NULL").select("group_key", "label", F.col("amount_minor").alias("seed"), F.signum("amount_minor").alias("_sign"), bucket("amount_minor").alias("_at")).distinct()
    near = "abs(amount_minor - seed) * 10 <= abs(seed)"
    reach = F.sequence(bucket("amount_minor", 0.9) - 1, bucket("amount_minor", 1.12) + 1)
    asks = rows.where("label IS NULL").select("event_id", "group_key", "amount_minor", F.signum("amount_minor").alias("_sign"), F.explode(reach).alias("_at"))
    met = asks.join(seeds, ["group_key", "_sign", "_at"]).where(near)
    out = met.groupBy("event_id").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label"))
    return out.select("event_id", F.when(F.col("k") == 1, F.col("label")).alias("target"), (F.col("k") > 1).alias("contested"))
