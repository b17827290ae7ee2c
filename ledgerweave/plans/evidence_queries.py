"""Queries of readers, asks, pending payments, identity, budgets, verification and profiles over the household tables, with SQL oracles.

The SQL states each rule afresh. Where payload bytes must be inflated, decoded or parsed, SQL cannot say it and the query has none; those
operators are tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asks, budget, identity, matching, pending, profile, terms, verification
from ..operators.ledger import project_events
from ..session import shared_folder
from ..sources import readers
from ..sources.artefacts import read_table

AS_OF = "2025-06-30"


def _paid(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with repeated rows once and empty ids as none."""
    return read_table(spark, sf, "transactions").distinct().withColumn("source_id", F.nullif(F.trim("source_id"), F.lit("")))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "raw_artefacts").drop("payload")


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    shared_folder(spark)
    rows = read_table(spark, sf, "raw_artefacts")
    return readers.read_all(rows).checkpoint(), rows


# --- readers -------------------------------------------------------------------------------------------------------------------


def canonical_records(spark, sf):
    return readers.canonical_records(*_read(spark, sf))


def artefact_problems(spark, sf):
    return readers.problems(_read(spark, sf)[0])


def reader_counts(spark, sf):
    """Per source and reader how many artefacts and records were read and how many artefacts were refused."""
    rows = _read(spark, sf)[0]
    return rows.groupBy("artefact_source", "reader").agg(F.count_distinct(F.when(F.col("refusal").isNull(), F.col("arrival_seq"))).alias("artefacts"), F.count_if(F.col("refusal").isNull()).alias("records"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))


def _of(reader):
    def query(spark, sf):
        read, rows = _read(spark, sf)
        return readers.canonical_records(read.where(F.col("reader") == reader), rows)

    return query


starling_csv_records, monzo_csv_records, amex_csv_records, qif_records = _of("starling-csv"), _of("monzo-csv"), _of("amex-uk-csv"), _of("qif")
aggregator_records, card_records, feed_records, pending_records = _of("truelayer-booked"), _of("truelayer-card-booked"), _of("starling-feed"), _of("truelayer-pending")


def artefact_dispatch(spark, sf):
    """Which artefacts tell of movements, by source."""
    return _raw(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("artefacts"), F.first(F.col("source").isin(*readers.NO_MOVEMENTS)).alias("skipped"))


def media_types(spark, sf):
    return read_table(spark, sf, "raw_artefacts").select("arrival_seq", scalars.media_type(F.col("payload"), F.col("origin")).alias("found"))


def qif_dates(spark, sf):
    mark = F.element_at(F.array(F.lit("/"), F.lit("-"), F.lit("."), F.lit("'")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.month(d), mark, F.dayofmonth(d) + 12, mark, F.year(d))).otherwise(F.concat(F.dayofmonth(d), mark, F.month(d), mark, F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yy")).otherwise(F.date_format(d, "yyyy"))))
    return read_table(spark, sf, "orders").select("o_orderkey", F.when((F.year(d) >= 2000) | (F.col("o_orderkey") % 3 != 0), scalars.qif_date(text)).alias("day"))


# --- scalars -------------------------------------------------------------------------------------------------------------------


def condensed(spark, sf):
    return read_table(spark, sf, "planted_events").select("event_id", scalars.condense(F.col("description")).alias("condensed")).distinct()


def claimed_windows(spark, sf):
    days = read_table(spark, sf, "transactions").groupBy(F.col("artefact_digest").alias("digest")).agg(F.min("value_date").alias("a"), F.max("value_date").alias("b"))
    rows = _raw(spark, sf).join(days, "digest", "left").withColumn("w", scalars.claimed_window(F.col("origin"), F.col("a"), F.col("b")))
    return rows.select("arrival_seq", F.col("w.claim_from").alias("claim_from"), F.col("w.claim_to").alias("claim_to"), scalars.claimed_note(F.col("w"), F.col("a"), F.col("b")).alias("note"))


def account_id_check(spark, sf):
    ids = read_table(spark, sf, "declared_accounts").select("account_id").union(read_table(spark, sf, "declared_accounts").select(F.concat(F.substring("account_id", 1, 4), F.substring("account_id", 6, 1), F.substring("account_id", 5, 1), F.substring("account_id", 7, 9))))
    return ids.distinct().select("account_id", scalars.account_id_ok(F.col("account_id")).alias("ok"))


def name_check(spark, sf):
    d = read_table(spark, sf, "declared_accounts")
    return d.select(F.explode(F.array("account_slug", "label", "account_id")).alias("name")).distinct().select("name", scalars.name_ok(F.col("name")).alias("ok"))


def slug_suggestions(spark, sf):
    return identity.slug_suggestions(read_table(spark, sf, "extendable_accounts"))


def rates_in_names(spark, sf):
    rows = read_table(spark, sf, "declared_accounts").withColumn("name", F.when(F.col("kind") == "card", F.concat("label", F.lit(" - 6.5%"))).otherwise(F.col("label")))
    return rows.select("account_id", scalars.name_stem(F.col("name")).alias("stem"), scalars.rate_in_name(F.col("name")).cast("double").alias("rate"))


def capital_values(spark, sf):
    kind = F.when(F.col("c_custkey") % 5 == 0, "state_pension").otherwise("defined_benefit")
    return read_table(spark, sf, "customer").select("c_custkey", scalars.capital_value(kind, F.round(F.abs("c_acctbal") * 100).cast("long"), F.when(F.col("c_custkey") % 3 != 0, F.lit(20))).alias("value_minor"))


def cadences(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("account_id", "description").orderBy("value_date")
    days = _paid(spark, sf).where("description IS NOT NULL").select("account_id", "description", "value_date").distinct()
    gaps = days.withColumn("gap", F.datediff("value_date", F.lag("value_date").over(w))).where("gap IS NOT NULL")
    return gaps.groupBy(F.coalesce(scalars.cadence(F.col("gap")), F.lit("irregular")).alias("cadence")).agg(F.count(F.lit(1)).alias("n"))


def phase_timings(spark, sf):
    """How long observations of a source waited to be recorded, as phases of a run."""
    seconds = F.unix_seconds("ingested_at") - F.unix_seconds(F.col("observed_at").cast("timestamp"))
    return budget.timings(read_table(spark, sf, "observations").distinct().select(F.col("source").alias("phase"), seconds.alias("seconds")).where("seconds IS NOT NULL"))


# --- filters -------------------------------------------------------------------------------------------------------------------


def internal_flags(spark, sf):
    """Claimed, confirmed and settled flags of payments; confirmed legs come from pairing the payments themselves."""
    shared_folder(spark)
    rows = project_events(read_table(spark, sf, "events")).checkpoint()
    pairs = matching.transfer_pairs(rows)
    legs = pairs.select(F.explode(F.array("debit_event_id", "credit_event_id")).alias("event_id"), F.lit(True).alias("confirmed"))
    return rows.join(legs, "event_id", "left").groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.count("confirmed").alias("confirmed"), F.count_if(F.col("status") == "booked").alias("settled"))


def format_doubts(spark, sf):
    return verification.format_doubts(_paid(spark, sf), ("account_id", "source", "artefact_digest"))


def lifecycle_breaches(spark, sf):
    """Payments outside the life of their account, which counts from its declaration where its opening is only inferred."""
    accounts = read_table(spark, sf, "declared_accounts").withColumn("opened", F.when(F.col("date_basis") == "inferred", F.to_date("declared_at")).otherwise(F.col("opened")))
    return verification.lifecycle_breaches(_paid(spark, sf), accounts)


def owned_ids(spark, sf):
    rows = _paid(spark, sf).select(F.when(F.col("status") == "void", F.concat(F.lit("by-hand-"), "entity_id")).otherwise(F.concat_ws(":", "content_key", F.col("occurrence").cast("string"))).alias("imported_id")).distinct()
    return rows.select("imported_id", scalars.owned_id(F.col("imported_id")).alias("owned"))


def evidence_aliases(spark, sf):
    """How many artefacts are evidence of each account under any of its names."""
    names = identity.aliases(read_table(spark, sf, "declared_accounts"), read_table(spark, sf, "extendable_accounts"))
    return _raw(spark, sf).join(names, F.col("account_ref") == F.col("alias")).groupBy("account_id").agg(F.count_distinct("arrival_seq").alias("artefacts"))


def consent_findings(spark, sf):
    """Connections whose ninety days of consent end soon, counted from their last landed ask, and the rung of each on the last day held."""
    rows = _raw(spark, sf).where("connection_id <> ''")
    last = rows.groupBy(F.col("connection_id").alias("connection")).agg(F.max(F.to_date("fetched_at")).alias("granted"))
    left = F.datediff(F.date_add("granted", 90), F.lit(AS_OF).cast("date"))
    return last.select("connection", left.alias("days_left"), scalars.rung(left, ((3, 3), (7, 2), (14, 1))).alias("rung"))


# --- joins ---------------------------------------------------------------------------------------------------------------------


def _pending(spark, sf):
    rows = _paid(spark, sf).where("value_date IS NOT NULL AND amount_minor IS NOT NULL")
    held = rows.where("status = 'pending'").select("entity_id", "account_id", "source_id", "amount_minor", "value_date", "description", F.to_date("last_seen_at").alias("seen"))
    newest = held.groupBy("account_id").agg(F.max("seen").alias("newest"))
    present = held.join(newest, "account_id").where("seen = newest")
    booked = rows.where("status = 'booked'").select("entity_id", "account_id", "amount_minor", "value_date", "description", F.col("first_seen_at").alias("arrival"))
    gone = pending.vanished(held.drop("seen"), held.select("account_id"), present.select("account_id", "source_id", "amount_minor", "value_date"))
    return gone, booked


def vanished_pending(spark, sf):
    """Pending payments that the newest day on which their account's pendings were seen no longer shows."""
    return _pending(spark, sf)[0].select("entity_id").distinct()


def pending_outcomes(spark, sf):
    return pending.outcomes(*_pending(spark, sf))


def pending_events(spark, sf):
    return pending.events(pending.outcomes(*_pending(spark, sf))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def source_breakdown(spark, sf):
    return identity.source_breakdown(read_table(spark, sf, "transactions"), _raw(spark, sf))


def sighting_expansion(spark, sf):
    return identity.sightings(read_table(spark, sf, "transactions"), _raw(spark, sf))


def attempts_ledger(spark, sf):
    return asks.attempts_ledger(_raw(spark, sf)).withColumn("fetched_at", F.unix_micros("fetched_at"))


def asked_span(spark, sf):
    rows = asks.asked_span(_raw(spark, sf))
    return rows.select("account_ref", "earliest_asked", "latest_asked", F.unix_micros("last_landed").alias("last_landed"))


def ask_windows(spark, sf):
    return asks.asked_windows(_raw(spark, sf)).select("arrival_seq", "asked_from", "asked_to")


def ask_bars(spark, sf):
    """Asks as their request records them: two in three with their window, the rest as bare routine asks."""
    raw = _raw(spark, sf)
    asked = F.when(F.col("arrival_seq") % 3 == 0, "routine").otherwise(F.col("origin"))
    return asks.ask_bars(raw.select(F.col("arrival_seq").alias("ask_id"), "source", "digest", asked.alias("asked"), F.col("fetched_at").alias("asked_at")), raw)


def timeline_segments(spark, sf):
    held = _paid(spark, sf).groupBy("account_id").agg(F.min("value_date").alias("earliest"), F.max("value_date").alias("latest"))
    probes = read_table(spark, sf, "extendable_accounts").groupBy("account_id").agg(F.min("probed_back_to").alias("probed"), F.min("boundary").alias("boundary"))
    span = asks.asked_span(_raw(spark, sf)).select(F.col("account_ref").alias("account_id"), F.col("latest_asked").alias("covered"))
    axes = held.join(probes, "account_id", "left").join(span, "account_id", "left").withColumn("axis_start", F.lit("2020-01-01").cast("date")).withColumn("axis_end", F.lit("2026-06-30").cast("date")).withColumn("today", F.lit(AS_OF).cast("date"))
    return asks.timeline_segments(axes)


def extend_bounds(spark, sf):
    held = read_table(spark, sf, "extendable_accounts").groupBy("account_id").agg(F.min("earliest").alias("earliest"))
    b = asks.extend_bounds(F.col("earliest"), 365, F.lit(AS_OF).cast("date"))
    return held.select("account_id", b["since"].alias("since"), b["until"].alias("until"))


def due_tiers(spark, sf):
    return asks.due_tiers(_raw(spark, sf), F.lit("2025-06-01 00:00:00").cast("timestamp"))


def spacing_gate(spark, sf):
    rows = asks.spacing_gate(_raw(spark, sf), F.lit("2025-06-01 00:00:00").cast("timestamp"))
    return rows.select("connection", "may_run")


def refusal_trends(spark, sf):
    rows = read_table(spark, sf, "events").select(F.concat(F.lit("conn-"), F.pmod("user_id", F.lit(9973))).alias("connection"), F.col("user_id").cast("string").alias("account"), F.col("ts").alias("asked_at"), F.col("event_id").alias("ask_id"), F.col("event_type").isin("error", "view").alias("refused"))
    return asks.refusal_trends(rows, F.lit("2024-01-20 00:00:00").cast("timestamp"), window_days=9, min_asks=2, span_hours=6)


def entity_orphans(spark, sf):
    t = lambda name: read_table(spark, sf, name)
    registry = {"transactions": (t("transactions"), "account_id"), "observations": (t("observations"), "account_id"), "planted_events": (t("planted_events"), "account_id"), "extendable_accounts": (t("extendable_accounts"), "account_id"), "raw_artefacts": (t("raw_artefacts"), "account_ref"), "documents": (t("documents"), "account_id"), "parents": (t("declared_accounts"), "parent")}
    return identity.orphans(registry, t("declared_accounts").where("kind <> 'card'"), "account_id")


def identifier_matches(spark, sf):
    left = identity.claims(read_table(spark, sf, "declared_accounts"), "account_id", "label")
    right = identity.claims(read_table(spark, sf, "extendable_accounts"), "provider_ref", "display")
    return identity.best_claims(left, right)


def prune_candidates(spark, sf):
    rows = _paid(spark, sf).where("status <> 'void'").select(F.concat_ws(":", "content_key", F.col("occurrence").cast("string")).alias("imported_id"))
    there = rows.union(_paid(spark, sf).select(F.concat_ws(":", "content_key", F.lit("9")).alias("imported_id"))).union(_paid(spark, sf).select(F.concat(F.lit("own-"), "entity_id").alias("imported_id"))).distinct()
    return budget.prune_candidates(there, rows, scalars.owned_id(F.col("imported_id")))


def upsert_transactions(spark, sf):
    rows = identity.upserted(_paid(spark, sf))
    return rows.select("entity_id", "account_id", "amount_minor", "value_date", "status", "occurrence", F.unix_micros("first_seen_at").alias("first_seen_at"), F.unix_micros("last_seen_at").alias("last_seen_at"))


def first_sightings(spark, sf):
    rows = _raw(spark, sf).select("digest", "account_ref", "source", "origin", "fetched_at", "arrival_seq")
    return identity.first_of_key(rows, ["digest", "account_ref", "source"], ["fetched_at", "arrival_seq"]).select("digest", "account_ref", "source", "origin", "arrival_seq")


def binding_merge(spark, sf):
    rows = read_table(spark, sf, "extendable_accounts").select(F.col("account_id").alias("canonical_id"), F.substring_index("provider_ref", "-", 1).alias("target"), F.coalesce("probed_back_to", "earliest").alias("minted_at")).where("canonical_id IS NOT NULL AND target IS NOT NULL AND minted_at IS NOT NULL").distinct()
    return identity.merge_bindings(rows)


def roster(spark, sf):
    return identity.roster(read_table(spark, sf, "declared_accounts").where("closed IS NULL"), read_table(spark, sf, "documents").where("account_id IS NOT NULL"))


def account_set_drift(spark, sf):
    """Accounts that joined or left each source between its last two days of observations."""
    return identity.newest_sets(read_table(spark, sf, "observations").select("source", "account_id", "observed_at").distinct(), "source", "account_id", ["observed_at"])


def display_labels(spark, sf):
    named = read_table(spark, sf, "observations").where("fact = 'name'").select("account_id", F.col("value").alias("name"), "observed_at").distinct()
    accounts = read_table(spark, sf, "declared_accounts").withColumn("label", F.when(F.col("kind") != "card", F.col("label")))
    return identity.display_labels(accounts, named)


def attribution_ladder(spark, sf):
    return identity.attribution_ladder(_raw(spark, sf), read_table(spark, sf, "extendable_accounts"), {"qif": "files", "amex-uk-csv": "files"})


def group_decisions(spark, sf):
    """Annotations that the worklist's decisions write to every member of a group."""
    members = read_table(spark, sf, "planted_events").select(F.col("event_id").alias("entity_id"), F.upper(F.trim(F.regexp_replace(F.regexp_replace("description", r"[0-9*#]+", ""), r"\s+", " "))).alias("group_key")).where("group_key IS NOT NULL").distinct()
    decisions = read_table(spark, sf, "worklist_groups").select(F.col("label").alias("group_key"), (F.col("deferred") > 0).alias("deferred"), F.when(F.col("repeating"), "commitment").otherwise("purchase").alias("category")).where("group_key <> ''").distinct()
    return identity.apply_to_group(members, decisions).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def annotation_log(spark, sf):
    """What stands after a log of writes and forgets."""
    log = read_table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.lit("category").alias("kind"), F.col("event_type").alias("value"), F.pmod("event_id", F.lit(3)).cast("int").alias("rank"), F.col("event_id").alias("seq"), (F.pmod("event_id", F.lit(7)) == 0).alias("forget"))
    return identity.annotations(log)


def rebound_ids(spark, sf):
    """New ids of the payments of accounts that have a parent, bound to it."""
    moved = read_table(spark, sf, "declared_accounts").where("parent IS NOT NULL").select("account_id", F.col("parent").alias("new_account")).distinct()
    return identity.rekeyed(_paid(spark, sf), moved)


def namespace_collisions(spark, sf):
    t = lambda name: read_table(spark, sf, name)
    return identity.collisions({"accounts": (t("declared_accounts"), "account_id"), "references": (t("raw_artefacts"), "account_ref"), "owners": (t("documents"), "account_id"), "sources": (t("source_schemas"), "source"), "feeds": (t("transactions"), "source")})


# --- budget, runs and backups --------------------------------------------------------------------------------------------------


def _payload(spark, sf):
    bindings = read_table(spark, sf, "declared_accounts").where("closed IS NULL").select("account_id", F.concat(F.lit("budget-"), "account_slug").alias("target"))
    confirmed = read_table(spark, sf, "planted_events").where("transfer_id IS NOT NULL").select(F.col("event_id").cast("string").alias("entity_id"))
    return budget.payload(_paid(spark, sf), bindings, confirmed), bindings


def budget_rows(spark, sf):
    return _payload(spark, sf)[0]


def push_envelope(spark, sf):
    return budget.push_envelope(_payload(spark, sf)[0])


def audit_envelope(spark, sf):
    out, bindings = _payload(spark, sf)
    return budget.audit_envelope(bindings, out)


def provision_list(spark, sf):
    return budget.provision(read_table(spark, sf, "declared_accounts"))


def declared_export(spark, sf):
    decisions = read_table(spark, sf, "observations").where("lower(provenance) LIKE 'human%'").select(F.col("account_id").alias("entity_id"), F.col("fact").alias("kind"), "value").distinct()
    rows = read_table(spark, sf, "declared_accounts").where("closed IS NULL").select(F.col("account_id").alias("entity_id"), F.col("account_slug").alias("content_key"), F.lit(0).alias("occurrence"))
    return budget.declared_export(decisions, rows)


def backup_check(spark, sf):
    """The copy is the distinct rows; its counts must lie between the counts of rows seen before and after."""
    names = ("transactions", "observations", "planted_events", "statement_rows")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    before = union([count(read_table(spark, sf, n), n) for n in names])
    copy = union([count(read_table(spark, sf, n).distinct(), n) for n in names])
    return budget.verify_backup(before, copy, before)


def outbox_waiting(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("published_at"))
    return budget.unpublished(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def newest_runs(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"))
    return budget.newest_runs(rows, 3).select("id", "kind")


def valuation_series(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("asset_id"), F.trunc("o_orderdate", "year").alias("observed_at"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderkey") % 5 < 3, F.round(F.col("o_totalprice") * 100).cast("long")).alias("value_minor"),
        F.when(F.col("o_orderkey") % 5 > 1, F.round(F.col("o_totalprice")).cast("long")).alias("annual_income_minor"), F.col("o_orderdate").alias("ingested_at"), F.col("o_orderkey").alias("seq"),
    )
    return budget.valuations(rows)


def irreplaceable(spark, sf):
    obs = read_table(spark, sf, "observations").distinct()
    return budget.irreplaceable({"human observations": obs.where("lower(provenance) LIKE 'human%'"), "model observations": obs.where("lower(provenance) LIKE 'model%'"), "declared accounts": read_table(spark, sf, "declared_accounts"), "file artefacts": _raw(spark, sf).where("source IN ('qif', 'starling-csv', 'monzo-csv', 'amex-uk-csv')")})


def unattributed_samples(spark, sf):
    """The five newest artefacts of each source without a connection (a report)."""
    rows = _raw(spark, sf).where("connection_id IS NULL OR connection_id = ''")
    ranked = rows.groupBy("source").agg(F.slice(F.reverse(F.array_sort(F.collect_set("arrival_seq"))), 1, 5).alias("_s"), F.count(F.lit(1)).alias("n"))
    return ranked.select("source", "n", F.explode("_s").alias("arrival_seq"))


# --- terms, verification and profiles ------------------------------------------------------------------------------------------


def rate_reversions(spark, sf):
    """Rates about to end; a card's statement prints what is owed without a sign."""
    rows = read_table(spark, sf, "observations")
    owed = F.when((F.col("fact") == "balance") & (F.col("source") == "card-statement") & ~F.contains("value", F.lit("-")), F.concat(F.lit("-"), "value")).otherwise(F.col("value"))
    return terms.reversions(rows.withColumn("value", owed), F.lit("2024-06-01").cast("date"))


def review_report(spark, sf):
    """Groups that wait for a decision by whether they repeat and are reference coded: how many, their members and the largest label."""
    rows = read_table(spark, sf, "worklist_groups")
    return rows.groupBy("repeating", "reference_coded").agg(F.count(F.lit(1)).alias("groups"), F.sum("member_count").cast("long").alias("members"), F.sum("deferred").cast("long").alias("deferred"), F.max_by("group_id", F.struct("member_count", -F.col("group_id"))).alias("largest"))


def worklist_order(spark, sf):
    """The worklist as people see it: wholly deferred groups last, then by size and label (the report shows 20)."""
    rows = read_table(spark, sf, "worklist_groups").withColumn("done", F.col("deferred") >= F.col("member_count"))
    return rows.orderBy("done", F.desc("member_count"), F.asc_nulls_first("label"), "group_id").limit(20).select("group_id", "done", "member_count")


def settlement_crossings(spark, sf):
    """Lags between value and booking day with how many cross an ISO week and a month."""
    v, b = F.col("value_date"), F.col("booking_date")
    lag = F.datediff(b, v)
    bucket = F.when(lag <= 0, "same-day").when(lag == 1, "1d").when(lag == 2, "2d").when(lag == 3, "3d").otherwise("4d+")
    week = (F.weekofyear(v) != F.weekofyear(b)) | (F.extract(F.lit("YEAROFWEEK"), v) != F.extract(F.lit("YEAROFWEEK"), b))
    return _paid(spark, sf).where("value_date IS NOT NULL AND booking_date IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(week).alias("cross_week"), F.count_if(F.trunc(v, "month") != F.trunc(b, "month")).alias("cross_month"))


def explain_flows(spark, sf):
    """Per stripped description: money in and out, payments, days of the month that hold most of them."""
    rows = _paid(spark, sf).where("status <> 'void' AND description IS NOT NULL").select("description", "amount_minor", F.dayofmonth("value_date").alias("dom"))
    per_day = rows.groupBy("description", "dom").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("amount_minor") > 0, F.col("amount_minor")).otherwise(0)).alias("i"), F.sum(F.when(F.col("amount_minor") < 0, F.col("amount_minor")).otherwise(0)).alias("o"))
    return per_day.groupBy("description").agg(F.sum("c").alias("n"), F.sum("i").alias("money_in"), F.sum("o").alias("money_out"), F.max_by("dom", F.struct("c", -F.col("dom"))).alias("usual_day"))


def file_verdicts(spark, sf):
    """Verdicts of invented files: the payments of an account and source with a running balance, read right or with turned signs."""
    from pyspark.sql import Window

    rows = _paid(spark, sf).where("status = 'booked' AND source IN ('starling-csv', 'amex-uk-csv', 'qif')").select(F.concat_ws("/", "account_id", "source").alias("file_id"), "source", "amount_minor", "value_date", F.struct("value_date", "entity_id", "first_seen_at", "amount_minor").alias("pos"))
    total = F.sum("amount_minor").over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    printed = rows.select("file_id", "pos", F.when(F.col("source") == "amex-uk-csv", -F.col("amount_minor")).otherwise(F.col("amount_minor")).alias("amount_minor"), F.when(F.col("source") != "qif", total).alias("balance"))
    return verification.verify_files(printed, rows.select("file_id", "amount_minor", "value_date"))


def duplication_levels(spark, sf):
    shared_folder(spark)
    return profile.duplication_levels(profile.record_leaves(read_table(spark, sf, "raw_artefacts")).checkpoint())


def path_shapes(spark, sf):
    shared_folder(spark)
    return profile.path_shapes(profile.record_leaves(read_table(spark, sf, "raw_artefacts")).checkpoint())


def disclosed_shapes(spark, sf):
    return profile.disclosed(path_shapes(spark, sf), DISCLOSURE)


def record_churn(spark, sf):
    """Fields in which later sightings of a record differ from its first."""
    rows = profile.churn(profile.record_leaves(read_table(spark, sf, "raw_artefacts")))
    return rows.groupBy("source", "path", "amends").agg(F.sum("changes").alias("changes"), F.count(F.lit(1)).alias("identities"))


def sighting_histogram(spark, sf):
    return profile.sighting_histogram(profile.record_leaves(read_table(spark, sf, "raw_artefacts")))


def historical_subaccounts(spark, sf):
    shared_folder(spark)
    rows = profile.record_leaves(read_table(spark, sf, "raw_artefacts"))
    none = spark.createDataFrame([], "uid string")
    return profile.historical_subaccounts(rows, none, none)


def amendment_cutoffs(spark, sf):
    at = lambda p: F.expr(f"get(filter(leaves, x -> x.path = '{p}'), 0).value")
    rows = profile.record_leaves(read_table(spark, sf, "raw_artefacts")).where("source = 'starling-feed' AND identity IS NOT NULL")
    return asks.amendment_cutoffs(rows.select(F.col("identity").alias("uid"), F.col("canonical").alias("rendered"), F.try_to_timestamp(at("transactionTime")).alias("happened"), F.try_to_timestamp(at("updatedAt")).alias("updated"), "fetched_at", "arrival_seq"))


# What may be shown of a path; the first rule that fits the path or its last part counts.
DISCLOSURE = ((r"(?i)^(currency|status|direction|source|transaction_type|transaction_category)$", "show"), (r"(?i)(time|timestamp|updatedAt|settlementTime)$", "shape"), (r"(?i)(uid|_id)$", "shape"), (r"(?i)^minorUnits$", "shape"))

NAMES = (
    "canonical_records artefact_problems reader_counts starling_csv_records monzo_csv_records amex_csv_records qif_records aggregator_records card_records feed_records pending_records artefact_dispatch media_types qif_dates "
    "condensed claimed_windows account_id_check name_check slug_suggestions rates_in_names capital_values cadences phase_timings internal_flags format_doubts lifecycle_breaches owned_ids evidence_aliases consent_findings "
    "vanished_pending pending_outcomes pending_events source_breakdown sighting_expansion attempts_ledger asked_span ask_windows ask_bars timeline_segments extend_bounds due_tiers spacing_gate refusal_trends entity_orphans identifier_matches "
    "prune_candidates upsert_transactions first_sightings binding_merge roster account_set_drift display_labels attribution_ladder group_decisions annotation_log rebound_ids namespace_collisions "
    "budget_rows push_envelope audit_envelope provision_list declared_export backup_check outbox_waiting newest_runs valuation_series irreplaceable unattributed_samples "
    "rate_reversions review_report worklist_order settlement_crossings explain_flows file_verdicts duplication_levels path_shapes disclosed_shapes record_churn sighting_histogram historical_subaccounts amendment_cutoffs"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_T = "WITH t AS (SELECT DISTINCT * REPLACE (nullif(trim(source_id), '') AS source_id) FROM transactions)"
_W = r"""WITH r AS (SELECT *, TRY_CAST(nullif(regexp_extract(origin, '(?:^|[?&\s])from=(\d{4}-\d{2}-\d{2})', 1), '') AS DATE) AS a, TRY_CAST(nullif(regexp_extract(origin, '(?:^|[?&\s])to=(\d{4}-\d{2}-\d{2})', 1), '') AS DATE) AS b FROM raw_artefacts),
w AS (SELECT * EXCLUDE (a, b), CASE WHEN a <= b THEN a END AS asked_from, CASE WHEN a <= b THEN b END AS asked_to FROM r)"""
_P = _T + """,
x AS (SELECT *, CAST(last_seen_at AS DATE) AS seen FROM t WHERE status = 'pending' AND value_date IS NOT NULL AND amount_minor IS NOT NULL),
n AS (SELECT x.* FROM x JOIN (SELECT account_id, max(seen) AS m FROM x GROUP BY 1) y ON y.account_id = x.account_id AND y.m = x.seen),
g AS (SELECT DISTINCT entity_id, account_id, amount_minor, value_date, description FROM x WHERE
  (source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.account_id = x.account_id AND n.source_id = x.source_id))
  OR (source_id IS NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.account_id = x.account_id AND n.amount_minor = x.amount_minor AND n.value_date = x.value_date))),
c AS (SELECT g.entity_id, b.entity_id AS settled_id, b.amount_minor AS settled_amount, row_number() OVER (PARTITION BY g.entity_id ORDER BY b.first_seen_at, b.entity_id) AS k
  FROM g JOIN t b ON b.status = 'booked' AND b.account_id = g.account_id AND b.value_date BETWEEN g.value_date AND g.value_date + 5 AND (b.amount_minor < 0) = (g.amount_minor < 0)
  WHERE length(regexp_replace(g.description, '\\s', '', 'g')) > 0 AND length(regexp_replace(b.description, '\\s', '', 'g')) > 0
    AND (contains(lower(regexp_replace(g.description, '\\s', '', 'g')), lower(regexp_replace(b.description, '\\s', '', 'g'))) OR contains(lower(regexp_replace(b.description, '\\s', '', 'g')), lower(regexp_replace(g.description, '\\s', '', 'g'))))),
o AS (SELECT e.entity_id, CASE WHEN settled_id IS NULL THEN 'released' ELSE 'settled' END AS outcome, settled_id, settled_amount FROM (SELECT DISTINCT entity_id FROM g) e LEFT JOIN c ON c.entity_id = e.entity_id AND k = 1)
"""
_SEEN = """WITH r AS (SELECT DISTINCT entity_id, account_id, source AS own, value_date, artefact_digest FROM transactions),
l AS (SELECT digest, source, min(CAST(fetched_at AS DATE)) AS fetched FROM raw_artefacts GROUP BY 1, 2),
s AS (SELECT entity_id, account_id, coalesce(l.source, own) AS source, min(coalesce(fetched, value_date)) AS observed_date FROM r LEFT JOIN l ON l.digest = r.artefact_digest GROUP BY 1, 2, 3)
"""
_PAY = _T + """,
b AS (SELECT account_id, 'budget-' || account_slug AS target FROM declared_accounts WHERE closed IS NULL),
p AS (SELECT DISTINCT target, content_key || ':' || occurrence AS imported_id, value_date, amount_minor, coalesce(nullif(trim(counterparty), ''), description) AS payee,
  concat_ws(' | ', CASE WHEN description <> coalesce(nullif(trim(counterparty), ''), description) THEN nullif(description, '') END, CASE WHEN status = 'pending' THEN 'pending' END) AS notes, status <> 'pending' AS cleared
  FROM t JOIN b ON b.account_id = t.account_id WHERE status <> 'void' AND content_key IS NOT NULL AND upper(trim(currency)) IN ('GBP', '') AND NOT coalesce(is_internal_transfer, false))
"""
_DAY = "strptime({}, '%Y-%m-%d')"
_ALPHABET = scalars.ACCOUNT_ALPHABET

ORACLES = {
    "artefact_dispatch": f"SELECT source, count(*) AS artefacts, source IN {readers.NO_MOVEMENTS} AS skipped FROM raw_artefacts GROUP BY 1",
    "media_types": r"""SELECT arrival_seq, CASE WHEN hex(payload) LIKE '255044462D%' THEN 'application/pdf' WHEN hex(payload) LIKE '7B%' OR hex(payload) LIKE '5B%' THEN 'application/json' ELSE
        CASE lower(regexp_extract(origin, '\.([A-Za-z]+)$', 1)) WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'qif' THEN 'application/qif' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END END AS found FROM raw_artefacts""",
    "qif_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR (year(o_orderdate) < 2000 AND o_orderkey % 3 = 0) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    "condensed": r"SELECT DISTINCT event_id, lower(regexp_replace(description, '\s', '', 'g')) AS condensed FROM planted_events",
    "claimed_windows": r"""WITH d AS (SELECT artefact_digest, min(value_date) AS a, max(value_date) AS b FROM transactions GROUP BY 1),
        r AS (SELECT r.*, d.a, d.b, regexp_extract_all(origin, '\d{4}-\d{2}-\d{2}') AS x FROM raw_artefacts r LEFT JOIN d ON d.artefact_digest = r.digest),
        c AS (SELECT *, CASE WHEN len(x) >= 2 AND x[1] <= x[2] THEN CAST(x[1] AS DATE) END AS f, CASE WHEN len(x) >= 2 AND x[1] <= x[2] THEN CAST(x[2] AS DATE) END AS g FROM r)
        SELECT arrival_seq, f AS claim_from, g AS claim_to, CASE WHEN f IS NULL OR a IS NULL THEN NULL WHEN a < f OR b > g THEN 'outside' WHEN a > f OR b < g THEN 'quiet:' || (a - f) || ',' || (g - b) ELSE 'full' END AS note FROM c""",
    "account_id_check": f"""WITH i AS (SELECT account_id FROM declared_accounts UNION SELECT substr(account_id, 1, 4) || substr(account_id, 6, 1) || substr(account_id, 5, 1) || substr(account_id, 7) FROM declared_accounts),
        s AS (SELECT *, list_sum(list_transform(range(1, 11), lambda k: k * (instr('{_ALPHABET}', substr(account_id, CAST(k AS INT) + 4, 1)) - 1))) AS w FROM i)
        SELECT account_id, regexp_full_match(account_id, 'acc_[{_ALPHABET}]{{11}}') AND substr('{_ALPHABET}', CAST(w % 32 AS INT) + 1, 1) = substr(account_id, 15, 1) AS ok FROM s""",
    "name_check": "SELECT DISTINCT name, coalesce(regexp_full_match(name, '[a-z0-9][a-z0-9-]{0,62}[a-z0-9]'), false) AS ok FROM (SELECT account_slug AS name FROM declared_accounts UNION SELECT label FROM declared_accounts UNION SELECT account_id FROM declared_accounts)",
    "slug_suggestions": r"""WITH r AS (SELECT DISTINCT provider_ref, connection, trim(split_part(display, '(', 1)) AS title FROM extendable_accounts), n AS (SELECT *, count(*) OVER (PARTITION BY connection, title) AS k FROM r),
        s AS (SELECT provider_ref, regexp_replace(regexp_replace(lower(trim(concat_ws('-', connection, CASE WHEN k > 1 THEN '' ELSE title END))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM n)
        SELECT DISTINCT provider_ref, regexp_replace(substr(s, 1, 64), '-+$', '') AS suggestion FROM s WHERE s <> ''""",
    "rates_in_names": "SELECT account_id, trim(label) AS stem, CASE WHEN kind = 'card' THEN 6.5::DOUBLE END AS rate FROM declared_accounts",
    "capital_values": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN CAST(round(abs(c_acctbal) * 100) AS BIGINT) * 20 END AS value_minor FROM customer",
    "cadences": """WITH d AS (SELECT DISTINCT account_id, description, value_date FROM transactions WHERE description IS NOT NULL), g AS (SELECT value_date - lag(value_date) OVER (PARTITION BY account_id, description ORDER BY value_date) AS gap FROM d)
        SELECT CASE WHEN gap BETWEEN 6 AND 8 THEN 'weekly' WHEN gap BETWEEN 13 AND 15 THEN 'fortnightly' WHEN gap BETWEEN 27 AND 32 THEN 'monthly' WHEN gap BETWEEN 88 AND 95 THEN 'quarterly' WHEN gap BETWEEN 360 AND 370 THEN 'annual' ELSE 'irregular' END AS cadence, count(*) AS n
        FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "phase_timings": """WITH s AS (SELECT source AS phase, CAST(floor(epoch(ingested_at)) AS BIGINT) - CAST(epoch(CAST(observed_at AS TIMESTAMP)) AS BIGINT) AS s FROM (SELECT DISTINCT * FROM observations))
        SELECT phase, count(*) AS runs, CAST(sum(s) AS BIGINT) AS total, min(s) AS least, quantile_cont(s, 0.5) AS middle, max(s) AS longest FROM s WHERE s IS NOT NULL GROUP BY 1""",
    "format_doubts": _T + " SELECT account_id, source, artefact_digest, count(*) AS n FROM t WHERE value_date IS NOT NULL GROUP BY 1, 2, 3 HAVING max(day(value_date)) <= 12",
    "lifecycle_breaches": _T + """, p AS (SELECT t.account_id, count(*) AS total, count(*) FILTER (value_date < opened) AS early, count(*) FILTER (value_date > closed) AS late FROM t JOIN (SELECT * REPLACE (CASE WHEN date_basis = 'inferred' THEN CAST(declared_at AS DATE) ELSE opened END AS opened) FROM declared_accounts) d ON d.account_id = t.account_id
        WHERE value_date IS NOT NULL AND (opened IS NOT NULL OR closed IS NOT NULL) GROUP BY 1)
        SELECT account_id, CASE WHEN early > 0 THEN 'before opening' ELSE 'after closing' END AS breach, CASE WHEN early > 0 THEN early ELSE late END AS n, total FROM p WHERE early + late > 0""",
    "owned_ids": _T + " SELECT DISTINCT imported_id, regexp_full_match(imported_id, '[0-9a-f]{64}:[0-9]+') AS owned FROM (SELECT CASE WHEN status = 'void' THEN 'by-hand-' || entity_id ELSE concat_ws(':', content_key, occurrence) END AS imported_id FROM t)",
    "evidence_aliases": """WITH a AS (SELECT account_id, account_id AS alias FROM declared_accounts UNION SELECT account_id, provider_ref FROM extendable_accounts WHERE account_id IS NOT NULL AND provider_ref IS NOT NULL)
        SELECT a.account_id, count(DISTINCT arrival_seq) AS artefacts FROM raw_artefacts JOIN a ON alias = account_ref GROUP BY 1""",
    "consent_findings": f"""WITH l AS (SELECT connection_id AS connection, CAST(max(CAST(fetched_at AS DATE)) + 90 - DATE '{AS_OF}' AS INTEGER) AS d FROM raw_artefacts WHERE connection_id <> '' GROUP BY 1)
        SELECT connection, d AS days_left, CASE WHEN d < 0 THEN NULL WHEN d <= 3 THEN 3 WHEN d <= 7 THEN 2 WHEN d <= 14 THEN 1 ELSE 0 END AS rung FROM l""",
    "vanished_pending": _P + "SELECT DISTINCT entity_id FROM g",
    "pending_outcomes": _P + "SELECT * FROM o",
    "pending_events": _P + "SELECT 'pending_' || outcome AS kind, count(*) AS n FROM o GROUP BY 1",
    "sighting_expansion": _SEEN + "SELECT * FROM s",
    "source_breakdown": _SEEN + """, m AS (SELECT entity_id, count(DISTINCT source) AS k FROM s GROUP BY 1),
        c AS (SELECT digest, arg_min(connection_id, arrival_seq) FILTER (connection_id <> '') AS connection FROM raw_artefacts GROUP BY 1),
        v AS (SELECT entity_id, min(connection) AS connection FROM (SELECT DISTINCT entity_id, artefact_digest FROM transactions) x LEFT JOIN c ON c.digest = x.artefact_digest GROUP BY 1)
        SELECT account_id, source, count(DISTINCT s.entity_id) AS payments, count(DISTINCT s.entity_id) FILTER (k > 1) AS corroborated, count(DISTINCT connection) AS connections FROM s JOIN m ON m.entity_id = s.entity_id LEFT JOIN v ON v.entity_id = s.entity_id GROUP BY 1, 2""",
    "attempts_ledger": """SELECT arrival_seq, r.digest, source, epoch_us(fetched_at) AS fetched_at, first_landing, origins FROM raw_artefacts r JOIN (SELECT digest, min(arrival_seq) AS first_landing, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM raw_artefacts GROUP BY 1) f ON f.digest = r.digest""",
    "asked_span": _W + " SELECT account_ref, min(asked_from) AS earliest_asked, max(coalesce(asked_to, CASE WHEN source = 'starling-feed' THEN CAST(fetched_at AS DATE) END)) AS latest_asked, max(epoch_us(fetched_at)) AS last_landed FROM w GROUP BY 1",
    "ask_windows": _W + " SELECT arrival_seq, asked_from, asked_to FROM w",
    "ask_bars": _W + """, d AS (SELECT digest, list(DISTINCT (asked_from, asked_to)) AS told FROM w WHERE asked_from IS NOT NULL GROUP BY 1),
        q AS (SELECT arrival_seq, source, CAST(fetched_at AS DATE) AS day, arrival_seq % 3 = 0 AS bare, asked_from AS f, asked_to AS t, told, fetched_at FROM w LEFT JOIN d ON d.digest = w.digest),
        k AS (SELECT *, CASE WHEN NOT bare AND f IS NOT NULL THEN 'recorded' WHEN len(told) = 1 THEN 'recovered' WHEN coalesce(len(told), 0) = 0 AND bare AND source IN ('truelayer-booked', 'truelayer-card-booked', 'starling-feed') THEN 'inferred' ELSE 'point' END AS p FROM q WHERE fetched_at IS NOT NULL)
        SELECT arrival_seq AS ask_id, source, CASE p WHEN 'recorded' THEN f WHEN 'recovered' THEN told[1][1] WHEN 'inferred' THEN day - 90 ELSE day END AS start_day, CASE p WHEN 'recorded' THEN t WHEN 'recovered' THEN told[1][2] ELSE day END AS end_day, p AS provenance,
          CASE WHEN p = 'recorded' AND len(told) > 0 THEN list_contains(told, (f, t)) END AS agrees FROM k""",
    "timeline_segments": _W + f""", h AS (SELECT account_id, min(value_date) AS earliest, max(value_date) AS latest FROM transactions GROUP BY 1),
        e AS (SELECT account_id, min(probed_back_to) AS probed, min(boundary) AS boundary FROM extendable_accounts GROUP BY 1),
        s AS (SELECT account_ref, max(coalesce(asked_to, CASE WHEN source = 'starling-feed' THEN CAST(fetched_at AS DATE) END)) AS covered FROM w GROUP BY 1),
        x AS (SELECT h.*, probed, boundary, covered FROM h LEFT JOIN e ON e.account_id = h.account_id LEFT JOIN s ON s.account_ref = h.account_id),
        d AS (SELECT DISTINCT account_id, unnest([DATE '2020-01-01', DATE '2026-06-30', boundary, probed, earliest, latest, covered, DATE '{AS_OF}']) AS p FROM x),
        c AS (SELECT account_id, p AS a, lead(p) OVER (PARTITION BY account_id ORDER BY p) AS b FROM d WHERE p BETWEEN DATE '2020-01-01' AND DATE '2026-06-30'),
        m AS (SELECT x.*, a, b, a + CAST((b - a) // 2 AS INTEGER) AS mid FROM c JOIN x ON x.account_id = c.account_id OR (x.account_id IS NULL AND c.account_id IS NULL) WHERE b IS NOT NULL),
        k AS (SELECT account_id, a, b, CASE WHEN mid > DATE '{AS_OF}' THEN 'future' WHEN mid BETWEEN earliest AND latest THEN 'held' WHEN mid >= probed AND (earliest IS NULL OR mid < earliest) THEN 'empty' WHEN mid > latest AND mid <= covered THEN 'empty' WHEN mid < boundary THEN 'truncated' ELSE 'unknown' END AS kind FROM m),
        j AS (SELECT *, CASE WHEN lag(kind) OVER v <> kind THEN 1 ELSE 0 END AS fresh FROM k WINDOW v AS (PARTITION BY account_id ORDER BY a)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY account_id ORDER BY a) AS position FROM j)
        SELECT account_id, CAST(position AS BIGINT) AS position, kind, CAST(sum(b - a) AS BIGINT) AS days FROM i GROUP BY 1, 2, 3""",
    "extend_bounds": f"WITH e AS (SELECT account_id, coalesce(min(earliest), DATE '{AS_OF}') AS x FROM extendable_accounts GROUP BY 1) SELECT account_id, CAST(x - 365 AS DATE) AS since, CAST(least(x + 1, DATE '{AS_OF}') AS DATE) AS until FROM e",
    "due_tiers": _W + """, c AS (SELECT connection_id AS connection, asked_to - asked_from AS wide, (epoch(TIMESTAMPTZ '2025-06-01 00:00:00+00') - floor(epoch(fetched_at))) / 3600 AS age FROM w WHERE connection_id IS NOT NULL),
        f AS (SELECT connection, count(*) FILTER (wide >= 2 AND age < 0) AS a, count(*) FILTER (wide >= 6 AND age < 24) AS b, count(*) FILTER (wide >= 55 AND age < 168) AS c FROM c GROUP BY 1)
        SELECT connection, CASE WHEN c = 0 THEN 56 WHEN b = 0 THEN 7 WHEN a = 0 THEN 3 END AS days_back FROM f""",
    "spacing_gate": "SELECT connection_id AS connection, epoch(TIMESTAMPTZ '2025-06-01 00:00:00+00') - floor(epoch(max(fetched_at))) >= 6 * 3600 AS may_run FROM raw_artefacts WHERE connection_id IS NOT NULL GROUP BY 1",
    "refusal_trends": """WITH a AS (SELECT 'conn-' || (user_id % 9973) AS connection, CAST(user_id AS VARCHAR) AS account, ts, event_id, event_type IN ('error', 'view') AS refused FROM events),
        o AS (SELECT *, sum(CASE WHEN refused THEN 0 ELSE 1 END) OVER (PARTITION BY connection, account ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM a),
        p AS (SELECT connection, account, count(*) FILTER (ok = 0) AS streak, epoch_us(max(ts) FILTER (ok = 0)) - epoch_us(min(ts) FILTER (ok = 0)) AS span, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') AS asks, count(*) FILTER (ts >= TIMESTAMP '2024-01-11' AND refused) AS refused FROM o GROUP BY 1, 2),
        r AS (SELECT *, CASE WHEN streak >= 3 AND span >= 21600000000 THEN 3 WHEN asks < 2 THEN 0 WHEN refused / asks >= 0.8 THEN 2 WHEN refused / asks >= 0.5 THEN 1 ELSE 0 END AS rung FROM p)
        SELECT connection, account, rung, refused, asks FROM r WHERE rung > 0""",
    "entity_orphans": "SELECT DISTINCT reference, key FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS reference, {c} AS key FROM {t}" for n, t, c in (("transactions", "transactions", "account_id"), ("observations", "observations", "account_id"), ("planted_events", "planted_events", "account_id"), ("extendable_accounts", "extendable_accounts", "account_id"), ("raw_artefacts", "raw_artefacts", "account_ref"), ("documents", "documents", "account_id"), ("parents", "declared_accounts", "parent"))) + ") WHERE key <> '' AND key NOT IN (SELECT account_id FROM declared_accounts WHERE kind <> 'card')",
    "identifier_matches": r"""WITH l AS (SELECT account_id, regexp_extract(label, '(\d{4,})\D*$', 1) AS d FROM declared_accounts), r AS (SELECT provider_ref, regexp_extract(display, '(\d{4,})\D*$', 1) AS d FROM extendable_accounts)
        SELECT DISTINCT account_id AS left_key, provider_ref AS right_key, CASE WHEN length(l.d) >= 6 AND l.d = r.d THEN 'number' ELSE 'last four' END AS kind FROM l JOIN r ON l.d <> '' AND right(l.d, 4) = right(r.d, 4)""",
    "prune_candidates": _T + " SELECT DISTINCT content_key || ':9' AS imported_id FROM t WHERE regexp_full_match(content_key, '[0-9a-f]{64}') AND NOT EXISTS (SELECT 1 FROM t u WHERE u.status <> 'void' AND u.content_key = t.content_key AND u.occurrence = 9)",
    "upsert_transactions": _T + """, x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY first_seen_at NULLS FIRST, content_key NULLS FIRST, occurrence NULLS FIRST) AS f, row_number() OVER (PARTITION BY entity_id ORDER BY last_seen_at DESC NULLS LAST, first_seen_at DESC NULLS LAST, content_key DESC NULLS LAST, occurrence DESC NULLS LAST, status DESC NULLS LAST) AS l FROM t WHERE entity_id IS NOT NULL),
        s AS (SELECT entity_id, min(first_seen_at) AS a, max(last_seen_at) AS b FROM x GROUP BY 1)
        SELECT n.entity_id, o.account_id, n.amount_minor, n.value_date, n.status, CASE WHEN o.content_key = n.content_key THEN o.occurrence ELSE n.occurrence END AS occurrence, epoch_us(a) AS first_seen_at, epoch_us(b) AS last_seen_at
        FROM x n JOIN x o ON o.entity_id = n.entity_id AND o.f = 1 JOIN s ON s.entity_id = n.entity_id WHERE n.l = 1""",
    "first_sightings": "SELECT digest, account_ref, source, origin, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY digest, account_ref, source ORDER BY fetched_at NULLS FIRST, arrival_seq) AS k FROM raw_artefacts) WHERE k = 1",
    "binding_merge": """WITH b AS (SELECT DISTINCT account_id AS canonical_id, split_part(provider_ref, '-', 1) AS target, coalesce(probed_back_to, earliest) AS minted FROM extendable_accounts WHERE account_id IS NOT NULL AND provider_ref IS NOT NULL AND coalesce(probed_back_to, earliest) IS NOT NULL),
        n AS (SELECT canonical_id, arg_max(target, (minted, target)) AS target FROM b GROUP BY 1) SELECT canonical_id, target FROM n WHERE target IN (SELECT target FROM n GROUP BY 1 HAVING count(*) = 1)""",
    "roster": """WITH d AS (SELECT DISTINCT account_id FROM declared_accounts WHERE closed IS NULL), s AS (SELECT DISTINCT account_id FROM documents WHERE account_id IS NOT NULL)
        SELECT coalesce(d.account_id, s.account_id) AS account_id, CASE WHEN d.account_id IS NULL THEN 'unnamed' WHEN s.account_id IS NULL THEN 'provision' ELSE 'syncing' END AS state FROM d FULL JOIN s ON s.account_id = d.account_id""",
    "account_set_drift": """WITH o AS (SELECT DISTINCT source, account_id, observed_at FROM observations), d AS (SELECT source, observed_at, row_number() OVER (PARTITION BY source ORDER BY observed_at DESC NULLS LAST) AS k FROM (SELECT DISTINCT source, observed_at FROM o)),
        h AS (SELECT o.source, account_id, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS now, max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS before FROM o JOIN d ON d.source = o.source AND d.observed_at = o.observed_at WHERE k <= 2 GROUP BY 1, 2)
        SELECT source AS key, account_id AS member, CASE WHEN now = 1 THEN 'joined' ELSE 'left' END AS change FROM h WHERE now <> before AND source IN (SELECT source FROM d WHERE k = 2)""",
    "display_labels": """WITH n AS (SELECT account_id, arg_max(value, (observed_at, value)) AS name FROM observations WHERE fact = 'name' AND trim(value) <> '' GROUP BY 1)
        SELECT d.account_id, coalesce(CASE WHEN kind <> 'card' THEN nullif(trim(label), '') END, trim(name), account_slug, d.account_id) AS label FROM declared_accounts d LEFT JOIN n ON n.account_id = d.account_id""",
    "attribution_ladder": """WITH o AS (SELECT account_id, min(connection) AS c FROM extendable_accounts WHERE account_id IS NOT NULL AND connection IS NOT NULL GROUP BY 1 HAVING count(DISTINCT connection) = 1)
        SELECT arrival_seq, coalesce(nullif(connection_id, ''), c, CASE WHEN source IN ('qif', 'amex-uk-csv') THEN 'files' END) AS connection,
          CASE WHEN connection_id <> '' THEN 'recorded' WHEN c IS NOT NULL THEN 'listed' WHEN source IN ('qif', 'amex-uk-csv') THEN 'default' ELSE 'unknown' END AS rung FROM raw_artefacts r LEFT JOIN o ON o.account_id = r.account_ref""",
    "group_decisions": r"""WITH m AS (SELECT DISTINCT event_id, upper(trim(regexp_replace(regexp_replace(description, '[0-9*#]+', '', 'g'), '\s+', ' ', 'g'))) AS g FROM planted_events WHERE description IS NOT NULL),
        d AS (SELECT DISTINCT label, deferred > 0 AS off, CASE WHEN repeating THEN 'commitment' ELSE 'purchase' END AS c FROM worklist_groups WHERE label <> '')
        SELECT CASE WHEN off THEN 'deferred' ELSE 'category' END AS kind, CASE WHEN off THEN 'true' ELSE c END AS value, count(*) AS n FROM m JOIN d ON d.label = m.g GROUP BY 1, 2""",
    "annotation_log": """WITH l AS (SELECT user_id AS e, event_type AS v, event_id % 3 AS r, event_id AS s, event_id % 7 = 0 AS f FROM events),
        w AS (SELECT * FROM l a WHERE NOT f AND NOT EXISTS (SELECT 1 FROM l b WHERE b.e = a.e AND b.f AND b.s > a.s AND b.r >= a.r)),
        b AS (SELECT e, r, arg_max(v, s) AS v FROM w GROUP BY 1, 2)
        SELECT e AS entity_id, 'category' AS kind, arg_max(v, r) AS value, CAST(max(r) AS INTEGER) AS rank FROM b GROUP BY 1""",
    "rebound_ids": _T + """ SELECT DISTINCT entity_id AS old_id, substr(sha256(parent || chr(31) || source || chr(31) || coalesce(nullif(source_id, ''), content_key || '#' || occurrence) || chr(31) || artefact_digest), 1, 32) AS new_id
        FROM t JOIN declared_accounts d ON d.account_id = t.account_id WHERE parent IS NOT NULL""",
    "namespace_collisions": "SELECT name, string_agg(space, ',' ORDER BY space) AS spaces FROM (" + " UNION ".join(f"SELECT '{s}' AS space, {c} AS name FROM {t}" for s, t, c in (("accounts", "declared_accounts", "account_id"), ("references", "raw_artefacts", "account_ref"), ("owners", "documents", "account_id"), ("sources", "source_schemas", "source"), ("feeds", "transactions", "source"))) + ") WHERE name <> '' GROUP BY 1 HAVING count(*) > 1",
    "budget_rows": _PAY + "SELECT * FROM p",
    "push_envelope": _PAY + ", e AS (SELECT target, imported_id, count(*) AS k FROM p GROUP BY 1, 2) SELECT target, CAST(sum(k) AS BIGINT) AS rows, count(*) FILTER (k > 1) AS repeated_ids, count(*) FILTER (k > 1) > 0 AS refused FROM e GROUP BY 1",
    "audit_envelope": _PAY + "SELECT b.target, count(p.target) AS rows FROM (SELECT DISTINCT target FROM b) b LEFT JOIN p ON p.target = b.target GROUP BY 1",
    "provision_list": "WITH r AS (SELECT DISTINCT account_id, account_slug, label FROM declared_accounts) SELECT account_id, CASE WHEN label IS NOT NULL AND count(*) OVER (PARTITION BY label) = 1 THEN label ELSE coalesce(account_slug, account_id) END AS label FROM r",
    "declared_export": """WITH o AS (SELECT DISTINCT account_id, fact, value FROM observations WHERE lower(provenance) LIKE 'human%')
        SELECT o.account_id AS entity_id, fact AS kind, value, account_slug AS content_key, CASE WHEN d.account_id IS NOT NULL THEN 0 END AS occurrence, d.account_id IS NULL AS orphan FROM o LEFT JOIN (SELECT * FROM declared_accounts WHERE closed IS NULL) d ON d.account_id = o.account_id""",
    "backup_check": " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS low, (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS copied, (SELECT count(*) FROM {n}) AS high, (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) = (SELECT count(*) FROM {n}) AS ok" for n in ("transactions", "observations", "planted_events", "statement_rows")),
    "outbox_waiting": "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id % 4 = 0 GROUP BY 1",
    "newest_runs": "SELECT id, kind FROM (SELECT event_id AS id, event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3",
    "valuation_series": """WITH r AS (SELECT o_custkey AS asset_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS observed_at, o_orderstatus AS source, CASE WHEN o_orderkey % 5 < 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS v, CASE WHEN o_orderkey % 5 > 1 THEN CAST(round(o_totalprice) AS BIGINT) END AS i, o_orderdate AS stamp, o_orderkey AS seq FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY asset_id, observed_at, source ORDER BY stamp DESC, seq DESC) AS k FROM r WHERE (v IS NULL) <> (i IS NULL)) SELECT asset_id, observed_at, source, v AS value_minor, i AS annual_income_minor FROM n WHERE k = 1""",
    "irreplaceable": """WITH o AS (SELECT DISTINCT * FROM observations) SELECT 'human observations' AS kind, count(*) FILTER (lower(provenance) LIKE 'human%') AS n FROM o UNION ALL SELECT 'model observations', count(*) FILTER (lower(provenance) LIKE 'model%') FROM o
        UNION ALL SELECT 'declared accounts', count(*) FROM declared_accounts UNION ALL SELECT 'file artefacts', count(*) FILTER (source IN ('qif', 'starling-csv', 'monzo-csv', 'amex-uk-csv')) FROM raw_artefacts""",
    "unattributed_samples": "SELECT source, n, arrival_seq FROM (SELECT source, count(*) OVER (PARTITION BY source) AS n, arrival_seq, row_number() OVER (PARTITION BY source ORDER BY arrival_seq DESC) AS k FROM raw_artefacts WHERE connection_id IS NULL OR connection_id = '') WHERE k <= 5",
    "rate_reversions": r"""WITH o AS (SELECT *, CASE WHEN source = 'card-statement' AND value NOT LIKE '%-%' THEN -1 ELSE 1 END * CAST(TRY_CAST(regexp_replace(value, '[^0-9.\-]', '', 'g') AS DECIMAL(20, 2)) * 100 AS BIGINT) AS b FROM observations),
        l AS (SELECT account_id, arg_max(b, (observed_at, observation_id)) AS b FROM o WHERE fact = 'balance' AND b IS NOT NULL GROUP BY 1),
        e AS (SELECT DISTINCT account_id, window_to, value, window_to - DATE '2024-06-01' AS d FROM observations WHERE fact IN ('rate', 'promo_rate') AND window_to IS NOT NULL)
        SELECT e.account_id, window_to, value, -b AS owed, CASE WHEN d <= 7 THEN 4 WHEN d <= 14 THEN 3 WHEN d <= 30 THEN 2 ELSE 1 END AS rung FROM e JOIN l ON l.account_id = e.account_id WHERE b < 0 AND d BETWEEN 0 AND 60""",
    "review_report": "SELECT repeating, reference_coded, count(*) AS groups, CAST(sum(member_count) AS BIGINT) AS members, CAST(sum(deferred) AS BIGINT) AS deferred, arg_max(group_id, (member_count, -group_id)) AS largest FROM worklist_groups GROUP BY 1, 2",
    "worklist_order": "SELECT group_id, deferred >= member_count AS done, member_count FROM worklist_groups ORDER BY done, member_count DESC, label NULLS FIRST, group_id LIMIT 20",
    "settlement_crossings": _T + """ SELECT CASE WHEN d <= 0 THEN 'same-day' WHEN d = 1 THEN '1d' WHEN d = 2 THEN '2d' WHEN d = 3 THEN '3d' ELSE '4d+' END AS bucket, count(*) AS n, count(*) FILTER (yearweek(value_date) <> yearweek(booking_date)) AS cross_week, count(*) FILTER (date_trunc('month', value_date) <> date_trunc('month', booking_date)) AS cross_month
        FROM (SELECT *, booking_date - value_date AS d FROM t) WHERE d IS NOT NULL GROUP BY 1""",
    "explain_flows": _T + """, r AS (SELECT description, amount_minor, day(value_date) AS dom FROM t WHERE status <> 'void' AND description IS NOT NULL), c AS (SELECT description, dom, count(*) AS c FROM r GROUP BY 1, 2), u AS (SELECT description, dom, row_number() OVER (PARTITION BY description ORDER BY c DESC, dom NULLS LAST) AS k FROM c)
        SELECT r.description, count(*) AS n, CAST(coalesce(sum(amount_minor) FILTER (amount_minor > 0), 0) AS BIGINT) AS money_in, CAST(coalesce(sum(amount_minor) FILTER (amount_minor < 0), 0) AS BIGINT) AS money_out, any_value(CAST(u.dom AS INTEGER)) AS usual_day FROM r JOIN u ON u.description = r.description AND k = 1 GROUP BY 1""",
}
