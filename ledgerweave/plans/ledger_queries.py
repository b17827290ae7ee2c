"""Queries of the ledger operators over the star-schema tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fold, matching, statements
from ..operators import ledger as ops
from ..sources.artefacts import read_table


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ops.project_events(read_table(spark, sf, "events"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated rows of an account seen by three sources."""
    source = F.when(F.col("o_orderkey") % 3 == 0, "starling").when(F.col("o_orderkey") % 3 == 1, "truelayer").otherwise("qif")
    return read_table(spark, sf, "orders").select(
        F.concat(F.lit("cust-"), F.pmod("o_custkey", F.lit(29))).alias("account_id"), source.alias("source"), F.to_date("o_orderdate").alias("value_date"),
        (F.floor(F.col("o_totalprice") / 100000) * 1000).cast("long").alias("amount_minor"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("arrival_seq"),
    )


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(F.concat(F.lit("conn-"), F.pmod("user_id", F.lit(97))).alias("connection"), F.col("ts").alias("asked_at"), F.col("event_id").alias("ask_id"), (F.col("event_type") == "error").alias("refused"))


def coverage(spark, sf):
    return ops.coverage(_ledger(spark, sf))


def coverage_net(spark, sf):
    return ops.coverage(_ledger(spark, sf), ("account_id",)).select("account_id", "n", "net")


def ledger_rollup(spark, sf):
    return _ledger(spark, sf).rollup("account_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("net"))


def source_counts(spark, sf):
    return ops.source_counts(ops.sightings(_ledger(spark, sf)))


def corroboration(spark, sf):
    return ops.corroboration(ops.sightings(_ledger(spark, sf)))


def content_key(spark, sf):
    return ops.with_keys(_ledger(spark, sf)).select("event_id", "content_key")


def occurrence_number(spark, sf):
    return ops.with_keys(_ledger(spark, sf)).select("event_id", "occurrence")


def entity_id(spark, sf):
    return ops.entity_ids(ops.with_keys(_ledger(spark, sf)))


def artefact_digest(spark, sf):
    return read_table(spark, sf, "raw_artefacts").select("arrival_seq", F.sha2("payload", 256).alias("digest"))


def normalise_description(spark, sf):
    rows = read_table(spark, sf, "planted_events").select("event_id", F.concat_ws(" ", "description", "merchant").alias("text")).distinct()
    return rows.select("event_id", scalars.normalise_description(F.col("text")).alias("plain")).distinct()


def group_key(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", ops.group_key(F.col("p_name")).alias("label"), ops.reference_coded(F.col("p_name")).alias("reference_coded"))


def parse_amount(spark, sf):
    """Printed amounts in every notation that files use, those that must be refused included."""
    shown = F.format_string("%.2f", F.col("o_totalprice"))
    kind = F.col("o_orderkey") % 8
    text = (
        F.when(kind == 0, F.concat(F.lit(" £"), F.format_number("o_totalprice", 2))).when(kind == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(kind == 2, F.concat(F.lit("."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")))
        .when(kind == 3, F.concat(F.lit("-"), shown, F.lit("0"))).when(kind == 4, F.concat(shown, F.lit("5"))).when(kind == 5, F.concat(F.lit("+"), shown)).when(kind == 6, F.concat(F.lit("EUR "), shown)).otherwise(shown)
    )
    currency = F.when(F.col("o_orderkey") % 16 == 7, "EUR").otherwise("GBP")
    return read_table(spark, sf, "orders").select("o_orderkey", scalars.parse_amount(text, currency).alias("minor"))


def format_amount(spark, sf):
    return _ledger(spark, sf).select("event_id", scalars.format_amount(F.col("amount_minor") + 5).alias("shown"))


def content_match(spark, sf):
    return ops.content_match(ops.with_keys(_ledger(spark, sf)))


def nearest_fuzzy_match(spark, sf):
    return ops.nearest_fuzzy_match(ops.with_keys(_ledger(spark, sf)))


def recurring_series(spark, sf):
    return ops.recurring_series(_orders(spark, sf))


def transfer_pairs(spark, sf):
    return matching.transfer_pairs(_ledger(spark, sf))


def resolve_fold(spark, sf):
    return fold.resolve(ops.with_keys(_ledger(spark, sf)))


def review_queue(spark, sf):
    return fold.resolve(ops.with_keys(_ledger(spark, sf))).where("needs_review").select("event_id", "entity_id")


def fold_summary(spark, sf):
    return fold.resolve(ops.with_keys(_ledger(spark, sf))).groupBy("account_id", "match_tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))


def agreement_leftovers(spark, sf):
    return matching.leftovers(_ledger(spark, sf))


def sibling_attribution(spark, sf):
    rows = _ledger(spark, sf)
    return matching.sibling_attribution(rows, matching.leftovers(rows).checkpoint())


def destination_doubt(spark, sf):
    rows = _ledger(spark, sf)
    return matching.destination_doubt(rows, matching.sibling_attribution(rows, matching.leftovers(rows).checkpoint()))


def agreement_figures(spark, sf):
    return ops.agreement(_ledger(spark, sf))


def month_gaps(spark, sf):
    return ops.month_gaps(_orders(spark, sf))


def gap_witnesses(spark, sf):
    return ops.gap_witnesses(_orders(spark, sf))


def transpositions(spark, sf):
    return ops.transpositions(_orders(spark, sf))


def stale_feeds(spark, sf):
    return ops.stale_feeds(_orders(spark, sf))


def balance_walk(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("account_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").alias("pos"), F.col("l_quantity").cast("long").alias("amount_minor"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") * 10).cast("long").alias("balance"),
    )
    return ops.balance_walk(rows)


def settlement_lag(spark, sf):
    return ops.settlement_lag(read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), read_table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"))


def duplication(spark, sf):
    return ops.duplication(read_table(spark, sf, "raw_artefacts").select("source", F.sha2("payload", 256).alias("digest")))


def items_by_month(spark, sf):
    return _orders(spark, sf).groupBy("source", F.date_format("value_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def sign_by_category(spark, sf):
    category = F.substring_index("description", " ", 1)
    return _ledger(spark, sf).groupBy(category.alias("category")).agg(F.count_if(F.col("amount_minor") > 0).alias("positive"), F.count_if(F.col("amount_minor") < 0).alias("negative"), F.count_if(F.col("amount_minor") == 0).alias("zero"))


def worklist(spark, sf):
    return ops.worklist(_ledger(spark, sf))


def explain(spark, sf):
    return ops.explain(_ledger(spark, sf))


def rule_sweep(spark, sf):
    rules = spark.createDataFrame([(1, "alpha", ""), (2, "steel", "metal"), (3, "a", "letter"), (4, "nothing-has-this", "never")], "rule_no int, needle string, value string")
    parts = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return ops.first_match_rules(parts, rules)


def annotation_winner(spark, sf):
    log = read_table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), F.col("props").alias("value"), F.pmod("event_id", F.lit(3)).alias("rank"), F.col("event_id").alias("seq"))
    return ops.annotation_winner(log)


def refusal_streaks(spark, sf):
    return ops.refusal_streaks(_asks(spark, sf))


def asks_last_day(spark, sf):
    return _asks(spark, sf).where("asked_at >= timestamp_ntz'2024-01-10 00:00:00' AND asked_at < timestamp_ntz'2024-01-11 00:00:00'").groupBy("connection").agg(F.count(F.lit(1)).alias("asks"), F.count_if("refused").alias("refused"))


def audit_partition(spark, sf):
    rows = _ledger(spark, sf).where("status = 'booked'").select(F.col("event_id").alias("imported_id"), "amount_minor")
    there = rows.where("imported_id % 7 <> 0").withColumn("amount_minor", F.when(F.col("imported_id") % 13 == 0, F.col("amount_minor") + 1).otherwise(F.col("amount_minor")))
    extra = there.where("imported_id % 17 = 0").select((-F.col("imported_id") - 1).alias("imported_id"), "amount_minor")
    return ops.audit_partition(rows, there.unionByName(extra))


def unbound_accounts(spark, sf):
    """Accounts with payments that no feed connection is bound to."""
    known = read_table(spark, sf, "extendable_accounts").where("connection NOT LIKE 'qif-%' AND connection NOT LIKE 'amex-%'").select("account_id")
    return read_table(spark, sf, "transactions").select("account_id").distinct().join(known, "account_id", "left_anti")


def landed_once(spark, sf):
    """Idempotent landing: the first delivery of each (digest, account, source)."""
    rows = read_table(spark, sf, "raw_artefacts").select("arrival_seq", "account_ref", "source", "fetched_at", F.sha2("payload", 256).alias("digest"))
    first = rows.groupBy("digest", "account_ref", "source").agg(F.min(F.struct("fetched_at", "arrival_seq")).alias("f"), F.count(F.lit(1)).alias("deliveries"))
    return first.select("digest", "account_ref", "source", F.col("f.arrival_seq").alias("arrival_seq"), "deliveries")


def status_counts(spark, sf):
    return read_table(spark, sf, "transactions").distinct().groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("net"))


def observation_projection(spark, sf):
    """The best reading per (account, fact, kind, window)."""
    from ..operators.history import provenance_rank

    rows = read_table(spark, sf, "observations").where("value IS NOT NULL")
    best = F.max(F.struct(provenance_rank(F.col("provenance")).alias("rank"), "observed_at", "observation_id"))
    return rows.groupBy("account_id", "fact", "kind", "window_from", "window_to").agg(best.alias("b")).select("account_id", "fact", "kind", "window_from", "window_to", F.col("b.observation_id").alias("observation_id"))


def current_view(spark, sf):
    """What applies on a day: readings whose inclusive, open-ended window holds it, the best per (account, fact, kind)."""
    from ..operators.history import provenance_rank

    rows = read_table(spark, sf, "observations").where("value IS NOT NULL AND (window_from IS NULL OR window_from <= DATE'2024-06-30') AND (window_to IS NULL OR window_to >= DATE'2024-06-30') AND observed_at <= DATE'2024-06-30'")
    best = F.max_by("value", F.struct(provenance_rank(F.col("provenance")), "observed_at", "observation_id"))
    return rows.groupBy("account_id", "fact", "kind").agg(best.alias("value"))


def attribution_gaps(spark, sf):
    return read_table(spark, sf, "raw_artefacts").groupBy("source").agg(F.count(F.lit(1)).alias("artefacts"), F.count_if(F.col("connection_id").isNull() | (F.col("connection_id") == "")).alias("unattributed"), F.count_if(F.col("record_count").isNull()).alias("uncounted"))


def could_be_one_payment(spark, sf):
    """The decision ladder on neighbouring observations of an account, amount and day."""
    keyed = ops.with_keys(_ledger(spark, sf))
    w = Window.partitionBy("account_id", "amount_minor", "value_date").orderBy("arrival_seq")
    cols = ("source", "tier", "source_id", "status", "content_key", "occurrence")
    both = keyed.select("event_id", *[F.col(c).alias(f"a_{c}") for c in cols], *[F.lag(c).over(w).alias(f"b_{c}") for c in cols]).where("b_source IS NOT NULL")
    return both.select("event_id", ops.could_be_one_payment("a_", "b_", F.col("a_content_key") == F.col("b_content_key")).alias("one_payment"))


def id_match(spark, sf):
    return ops.id_match(_ledger(spark, sf).withColumn("source_id", F.when(F.col("source_id").isNotNull(), F.concat(F.lit("id-"), F.floor(F.col("event_id") / 500)))))


def source_connections(spark, sf):
    return ops.source_connections(read_table(spark, sf, "transactions"), read_table(spark, sf, "raw_artefacts"))


def walk_convention(spark, sf):
    rows = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("account_id"), F.col("l_linenumber").alias("pos")).agg(F.floor(F.sum("l_quantity")).cast("long").alias("amount_minor"))
    total = F.sum("amount_minor").over(Window.partitionBy("account_id").orderBy("pos"))
    return ops.walk_convention(rows.withColumn("balance", F.when(F.col("account_id") % 3 == 0, -total).otherwise(total)))


def shape_summary(spark, sf):
    return ops.shape_summary(read_table(spark, sf, "raw_artefacts"), ["source", "account_ref", "media_type", "origin", "record_count", "connection_id"])


def presence_links(spark, sf):
    return ops.presence_links(read_table(spark, sf, "planted_events"), "kind", "transfer_id")


def dead_rules(spark, sf):
    rules = spark.createDataFrame([(2, "steel", "metal"), (3, "a", "letter"), (4, "nothing-has-this", "never")], "rule_no int, needle string, value string")
    return ops.dead_rules(read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), rules)


def alert_edges(spark, sf):
    day = lambda a, b: _asks(spark, sf).where(f"refused AND asked_at >= timestamp_ntz'{a}' AND asked_at < timestamp_ntz'{b}'").groupBy(F.col("connection").alias("key")).agg(F.count(F.lit(1)).alias("rung"))
    return ops.alert_edges(day("2024-01-10", "2024-01-12"), day("2024-01-12", "2024-01-14"))


def rebuild_diff(spark, sf):
    rows = _ledger(spark, sf)
    return ops.rebuild_diff(rows.where("value_date < DATE'2024-01-10'"), rows.where("value_date >= DATE'2024-01-20'"))


def orphan_rows(spark, sf):
    return ops.orphan_rows(read_table(spark, sf, "transactions").select("entity_id", "artefact_digest").distinct(), "artefact_digest", read_table(spark, sf, "raw_artefacts"), "digest").select("entity_id", "artefact_digest")


def mask_text(spark, sf):
    return read_table(spark, sf, "planted_events").select("event_id", scalars.mask_line(F.col("description")).alias("masked")).distinct()


def budget_payload(spark, sf):
    return ops.budget_payload(_ledger(spark, sf))


def duplicate_ids(spark, sf):
    return ops.duplicate_ids(ops.budget_payload(_ledger(spark, sf)))


def propagation(spark, sf):
    rows = read_table(spark, sf, "planted_events").dropDuplicates(["event_id"]).select("event_id", "amount_minor", ops.group_key(F.col("description")).alias("group_key"), F.when(F.col("event_id") % 3 == 0, F.col("kind")).alias("label"))
    return ops.propagation(rows)


def statement_lines(spark, sf):
    """Rows read off the statement texts among the documents."""
    docs = read_table(spark, sf, "documents").where("lower(trim(source)) RLIKE '^statement' AND text IS NOT NULL")
    lines = docs.select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return statements.statement_rows(lines).select("doc_id", "section", "position", "description", "amount_minor")


def statement_gate(spark, sf):
    """Verdicts over the same texts."""
    docs = read_table(spark, sf, "documents").where("lower(trim(source)) RLIKE '^statement' AND text IS NOT NULL")
    return statements.statement_gate(docs.select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")))


NAMES = (
    "coverage coverage_net ledger_rollup source_counts corroboration content_key occurrence_number entity_id artefact_digest normalise_description group_key parse_amount "
    "format_amount content_match nearest_fuzzy_match recurring_series transfer_pairs resolve_fold review_queue fold_summary agreement_leftovers sibling_attribution destination_doubt agreement_figures month_gaps gap_witnesses transpositions stale_feeds balance_walk "
    "settlement_lag duplication items_by_month sign_by_category worklist explain rule_sweep annotation_winner refusal_streaks asks_last_day audit_partition unbound_accounts "
    "landed_once status_counts observation_projection current_view attribution_gaps could_be_one_payment id_match source_connections walk_convention shape_summary presence_links dead_rules alert_edges rebuild_diff "
    "orphan_rows mask_text budget_payload duplicate_ids propagation statement_lines statement_gate"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_L = """
WITH l AS (
  SELECT event_id, 'acct-' || (user_id % 97) AS account_id, CASE event_id % 3 WHEN 0 THEN 'starling' WHEN 1 THEN 'truelayer' ELSE 'qif' END AS source,
         CASE WHEN event_id % 3 = 2 THEN 'synthetic' ELSE 'authoritative' END AS tier, CASE WHEN event_id % 3 <> 2 THEN 'id-' || event_id END AS source_id,
         CAST(floor(value / 10) AS BIGINT) * 1000 * CASE WHEN event_type IN ('purchase', 'view', 'error') THEN -1 ELSE 1 END AS amount_minor,
         CAST(ts AS DATE) AS value_date, upper(event_type) || ' ' || (event_id % 4) AS description,
         CASE WHEN event_id % 11 = 0 THEN 'pending' ELSE 'booked' END AS status, event_id AS arrival_seq, sha256('batch-' || (event_id // 50)) AS artefact_digest FROM events)
"""
_K = _L + """,
p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM l),
c AS (SELECT *, sha256(amount_minor || chr(31) || strftime(value_date, '%Y-%m-%d') || chr(31) || plain) AS content_key FROM p),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY artefact_digest, account_id, content_key ORDER BY arrival_seq) - 1 AS INTEGER) AS occurrence FROM c)
"""
_ONE = """CASE WHEN a.source <> b.source THEN true WHEN (a.status = 'pending') <> (b.status = 'pending') THEN true
  WHEN a.tier = 'authoritative' AND b.tier = 'authoritative' AND a.source_id IS NOT NULL AND b.source_id IS NOT NULL THEN a.source_id = b.source_id
  WHEN NOT {same} THEN false ELSE a.occurrence = b.occurrence END"""
_SEEN = _L + ", s AS (SELECT event_id, account_id, source FROM l UNION ALL SELECT event_id, account_id, 'statement' FROM l WHERE event_id % 2 = 0)"
_O = """
WITH o AS (
  SELECT 'cust-' || (o_custkey % 29) AS account_id, CASE o_orderkey % 3 WHEN 0 THEN 'starling' WHEN 1 THEN 'truelayer' ELSE 'qif' END AS source,
         CAST(o_orderdate AS DATE) AS value_date, CAST(floor(o_totalprice / 100000) * 1000 AS BIGINT) AS amount_minor, o_orderpriority AS description, o_orderkey AS arrival_seq FROM orders)
"""
_GAPS = _O + """,
m AS (SELECT DISTINCT account_id, source, CAST(date_trunc('month', value_date) AS DATE) AS month FROM o),
n AS (SELECT *, lead(month) OVER (PARTITION BY account_id, source ORDER BY month) AS nxt FROM m),
g AS (SELECT account_id, source, CAST(unnest(generate_series(month + INTERVAL 1 MONTH, nxt - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM n WHERE nxt > month + INTERVAL 1 MONTH)
"""
_COVER = "count(*) AS n, min(value_date) AS first_date, max(value_date) AS last_date, CAST(sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS inflow, CAST(sum(CASE WHEN amount_minor < 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS outflow, CAST(sum(amount_minor) AS BIGINT) AS net, count(source_id) AS durable_ids"
_RANK = "CASE WHEN lower(provenance) LIKE 'human%' THEN 2 WHEN lower(provenance) LIKE 'model%' THEN 1 ELSE 0 END"



def _stripped(x: str) -> str:
    """SQL that strips the volatile fragments of a narrative."""
    for pattern in scalars.VOLATILE:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'gi')"
    return x


_FURNITURE = ", ".join(f"'{w}'" for w in scalars.FURNITURE)
_HIDE = "regexp_replace(regexp_replace(regexp_replace({}, '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g')"
ORACLES = {
    "coverage": _L + f"SELECT account_id, source, {_COVER} FROM l GROUP BY 1, 2",
    "coverage_net": _L + "SELECT account_id, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS net FROM l GROUP BY 1",
    "ledger_rollup": _L + "SELECT account_id, source, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS net FROM l GROUP BY ROLLUP (account_id, source)",
    "source_counts": _SEEN + "SELECT account_id, count(DISTINCT source) AS sources FROM s GROUP BY 1",
    "corroboration": _SEEN + ", e AS (SELECT account_id, event_id, count(DISTINCT source) AS k FROM s GROUP BY 1, 2) SELECT account_id, count(*) FILTER (k > 1) AS corroborated, count(*) FILTER (k = 1) AS single_source FROM e GROUP BY 1",
    "content_key": _K + "SELECT event_id, content_key FROM k",
    "occurrence_number": _K + "SELECT event_id, occurrence FROM k",
    "entity_id": _K + "SELECT event_id, substr(sha256(account_id || chr(31) || source || chr(31) || coalesce(source_id, content_key || '#' || occurrence) || chr(31) || artefact_digest), 1, 32) AS entity_id FROM k",
    "artefact_digest": "SELECT arrival_seq, sha256(payload) AS digest FROM raw_artefacts",
    "normalise_description": f"WITH t AS (SELECT DISTINCT event_id, strip_accents(concat_ws(' ', description, merchant)) AS x FROM planted_events) SELECT DISTINCT event_id, trim(regexp_replace(regexp_replace(lower({_stripped('x')}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM t",
    "group_key": "SELECT p_partkey, upper(trim(regexp_replace(regexp_replace(p_name, '[0-9*#]+', '', 'g'), '\\s+', ' ', 'g'))) AS label, coalesce(length(regexp_replace(p_name, '[^0-9]', '', 'g')) / nullif(length(p_name), 0) > 0.5, false) AS reference_coded FROM part",
    "parse_amount": """SELECT o_orderkey, CASE WHEN o_orderkey % 16 = 7 THEN NULL ELSE CASE o_orderkey % 8 WHEN 1 THEN -CAST(round(o_totalprice * 100) AS BIGINT) WHEN 3 THEN -CAST(round(o_totalprice * 100) AS BIGINT)
        WHEN 2 THEN o_orderkey % 100 WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END END AS minor FROM orders""",
    "format_amount": _L + "SELECT event_id, CASE WHEN amount_minor + 5 < 0 THEN '-' ELSE '' END || '£' || (abs(amount_minor + 5) // 100) || '.' || lpad(CAST(abs(amount_minor + 5) % 100 AS VARCHAR), 2, '0') AS shown FROM l",
    "content_match": _K + f"SELECT a.event_id, min(b.event_id) AS match_id FROM k a JOIN k b ON a.account_id = b.account_id AND a.content_key = b.content_key AND b.arrival_seq < a.arrival_seq WHERE {_ONE.format(same='true')} GROUP BY 1",
    "nearest_fuzzy_match": _K + f""", m AS (SELECT a.event_id, b.event_id AS match_id, CAST(abs(a.value_date - b.value_date) AS INTEGER) AS days FROM k a JOIN k b ON a.account_id = b.account_id AND a.amount_minor = b.amount_minor
        AND b.arrival_seq < a.arrival_seq AND abs(a.value_date - b.value_date) <= 7 AND a.content_key <> b.content_key WHERE {_ONE.format(same='false')})
        SELECT event_id, match_id, days FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY days, match_id) AS r FROM m) WHERE r = 1""",
    "recurring_series": _O + """, d AS (SELECT DISTINCT account_id, amount_minor, description, value_date FROM o),
        w AS (SELECT *, lag(value_date, 1) OVER x AS p1, lag(value_date, 2) OVER x AS p2 FROM d WINDOW x AS (PARTITION BY account_id, amount_minor, description ORDER BY value_date))
        SELECT account_id, amount_minor, description, value_date FROM w WHERE p2 IS NOT NULL AND abs((value_date - p1) - (p1 - p2)) <= 1""",
    "agreement_figures": _L + """, s AS (SELECT account_id, source, min(value_date) AS a, max(value_date) AS b FROM l GROUP BY 1, 2),
        p AS (SELECT x.account_id, x.source AS left_source, y.source AS right_source, greatest(x.a, y.a) AS overlap_from, least(x.b, y.b) AS overlap_to FROM s x JOIN s y ON x.account_id = y.account_id AND x.source < y.source),
        f AS (SELECT p.*, count(*) FILTER (l.source = left_source) AS left_n, count(*) FILTER (l.source = right_source) AS right_n,
          CAST(coalesce(sum(amount_minor) FILTER (l.source = left_source), 0) AS BIGINT) AS left_net, CAST(coalesce(sum(amount_minor) FILTER (l.source = right_source), 0) AS BIGINT) AS right_net
          FROM p JOIN l ON l.account_id = p.account_id AND l.source IN (left_source, right_source) AND l.value_date BETWEEN overlap_from AND overlap_to WHERE overlap_from <= overlap_to GROUP BY ALL)
        SELECT *, left_n = right_n AND left_net = right_net AS agrees FROM f""",
    "month_gaps": _GAPS + "SELECT account_id, source, month FROM g",
    "gap_witnesses": _GAPS + "SELECT g.account_id, g.source, g.month, count(DISTINCT m.source) AS witnesses FROM g LEFT JOIN m ON m.account_id = g.account_id AND m.month = g.month GROUP BY ALL",
    "transpositions": _O + """SELECT DISTINCT a.account_id, a.amount_minor, a.description, a.source AS left_source, b.source AS right_source, a.value_date AS left_date, b.value_date AS right_date
        FROM o a JOIN o b ON a.account_id = b.account_id AND a.amount_minor = b.amount_minor AND a.description = b.description AND a.source < b.source
        WHERE year(a.value_date) = year(b.value_date) AND month(a.value_date) = day(b.value_date) AND day(a.value_date) = month(b.value_date) AND a.value_date <> b.value_date
          AND NOT (EXISTS (SELECT 1 FROM o x WHERE x.account_id = a.account_id AND x.amount_minor = a.amount_minor AND x.description = a.description AND x.source = a.source AND x.value_date = b.value_date)
            AND EXISTS (SELECT 1 FROM o x WHERE x.account_id = a.account_id AND x.amount_minor = a.amount_minor AND x.description = a.description AND x.source = b.source AND x.value_date = a.value_date))""",
    "stale_feeds": _O + """, s AS (SELECT account_id, source, max(value_date) AS last_date FROM o GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY last_date DESC, source DESC) AS r FROM s)
        SELECT s.account_id, s.source, s.last_date, t.source AS witness, CAST(t.last_date - s.last_date AS INTEGER) AS days_behind FROM s JOIN t ON t.account_id = s.account_id AND t.r = 1 WHERE t.source <> s.source AND t.last_date - s.last_date > 3""",
    "balance_walk": """WITH x AS (SELECT l_orderkey AS account_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS pos, CAST(floor(l_quantity) AS BIGINT) AS amount_minor, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber * 10 AS BIGINT) END AS balance FROM lineitem),
        i AS (SELECT *, coalesce(count(balance) OVER (PARTITION BY account_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM x),
        g AS (SELECT account_id, island, sum(amount_minor) AS moved, max(balance) AS balance FROM i GROUP BY 1, 2),
        b AS (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY island) AS before FROM g)
        SELECT account_id, island, before + moved = balance AS holds FROM b WHERE before IS NOT NULL AND balance IS NOT NULL""",
    "settlement_lag": """SELECT CASE WHEN d <= 0 THEN 'same-day' WHEN d = 1 THEN '1d' WHEN d = 2 THEN '2d' WHEN d = 3 THEN '3d' ELSE '4d+' END AS bucket, count(*) AS n
        FROM (SELECT CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
    "duplication": "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS records, count(DISTINCT sha256(payload)) AS distinct_bytes, count(*) - count(DISTINCT sha256(payload)) AS redundant FROM raw_artefacts GROUP BY ROLLUP (source)",
    "items_by_month": _O + "SELECT source, strftime(value_date, '%Y-%m') AS month, count(*) AS n FROM o GROUP BY 1, 2",
    "sign_by_category": _L + "SELECT split_part(description, ' ', 1) AS category, count(*) FILTER (amount_minor > 0) AS positive, count(*) FILTER (amount_minor < 0) AS negative, count(*) FILTER (amount_minor = 0) AS zero FROM l GROUP BY 1",
    "worklist": _L + """, g AS (SELECT upper(trim(regexp_replace(regexp_replace(description, '[0-9*#]+', '', 'g'), '\\s+', ' ', 'g'))) AS label, * FROM l)
        SELECT label, count(*) AS members, arg_min(description, arrival_seq) AS example, count(DISTINCT description) AS distinct_descriptions,
          count(*) >= 3 AND count(DISTINCT description) <= greatest(2, count(*) // 10) AS repeating,
          coalesce(length(regexp_replace(arg_min(description, arrival_seq), '[^0-9]', '', 'g')) / nullif(length(arg_min(description, arrival_seq)), 0) > 0.5, false) AS reference_coded
        FROM g GROUP BY 1 ORDER BY members DESC, label LIMIT 20""",
    "explain": _L + """, w AS (SELECT *, value_date - lag(value_date) OVER (PARTITION BY description ORDER BY value_date, arrival_seq) AS gap FROM l),
        b AS (SELECT description, count(*) AS n, count(DISTINCT account_id) AS accounts, min(amount_minor) AS low, max(amount_minor) AS high, min(value_date) AS first_date, max(value_date) AS last_date, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM w GROUP BY 1),
        m AS (SELECT description, amount_minor, count(*) AS c, min(value_date) AS f, arg_min(arrival_seq, (value_date, arrival_seq)) AS q FROM l GROUP BY 1, 2),
        u AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY c DESC, f, q) AS r FROM m)
        SELECT b.description, n, accounts, low, high, first_date, last_date, u.amount_minor AS usual_amount, CAST(gaps[len(gaps) // 2 + 1] AS INTEGER) AS typical_gap FROM b JOIN u ON u.description = b.description AND r = 1""",
    "rule_sweep": """WITH r(rule_no, needle, value) AS (VALUES (2, 'steel', 'metal'), (3, 'a', 'letter'), (4, 'nothing-has-this', 'never'))
        SELECT p_partkey AS id, arg_min(value, rule_no) AS category, min(rule_no) AS rule_no FROM part LEFT JOIN r ON contains(lower(p_name || ' ' || p_type), needle) GROUP BY 1""",
    "annotation_winner": "SELECT user_id AS entity_id, event_type AS kind, arg_max(props, (event_id % 3) * 1000000000 + event_id) AS value, max(event_id % 3) AS rank FROM events GROUP BY 1, 2",
    "refusal_streaks": """WITH a AS (SELECT 'conn-' || (user_id % 97) AS connection, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id % 97 ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM events)
        SELECT connection, count(*) FILTER (ok = 0) AS streak, count(*) AS asks FROM a GROUP BY 1""",
    "asks_last_day": "SELECT 'conn-' || (user_id % 97) AS connection, count(*) AS asks, count(*) FILTER (event_type = 'error') AS refused FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1",
    "audit_partition": _L + """, e AS (SELECT event_id AS id, amount_minor AS x FROM l WHERE status = 'booked'),
        t AS (SELECT id, CASE WHEN id % 13 = 0 THEN x + 1 ELSE x END AS x FROM e WHERE id % 7 <> 0),
        a AS (SELECT id, count(*) AS n, sum(x) AS x FROM (SELECT * FROM t UNION ALL SELECT -id - 1, x FROM t WHERE id % 17 = 0) GROUP BY 1)
        SELECT CASE WHEN a.n > 1 THEN 'duplicated' WHEN a.n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'orphaned' WHEN e.x <> a.x THEN 'diverged' ELSE 'present' END AS state, count(*) AS n FROM e FULL JOIN a ON e.id = a.id GROUP BY 1""",
    "unbound_accounts": "SELECT DISTINCT account_id FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM extendable_accounts d WHERE d.account_id = t.account_id AND connection NOT LIKE 'qif-%' AND connection NOT LIKE 'amex-%')",
    "landed_once": "SELECT sha256(payload) AS digest, account_ref, source, arg_min(arrival_seq, (fetched_at, arrival_seq)) AS arrival_seq, count(*) AS deliveries FROM raw_artefacts GROUP BY 1, 2, 3",
    "status_counts": "SELECT source, status, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS net FROM (SELECT DISTINCT * FROM transactions) GROUP BY 1, 2",
    "observation_projection": f"SELECT account_id, fact, kind, window_from, window_to, arg_max(observation_id, ({_RANK}, observed_at, observation_id)) AS observation_id FROM observations WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5",
    "current_view": f"SELECT account_id, fact, kind, arg_max(value, ({_RANK}, observed_at, observation_id)) AS value FROM observations WHERE value IS NOT NULL AND (window_from IS NULL OR window_from <= DATE '2024-06-30') AND (window_to IS NULL OR window_to >= DATE '2024-06-30') AND observed_at <= DATE '2024-06-30' GROUP BY 1, 2, 3",
    "attribution_gaps": "SELECT source, count(*) AS artefacts, count(*) FILTER (connection_id IS NULL OR connection_id = '') AS unattributed, count(*) FILTER (record_count IS NULL) AS uncounted FROM raw_artefacts GROUP BY 1",
    "could_be_one_payment": _K + f""", n AS (SELECT *, lag(event_id) OVER (PARTITION BY account_id, amount_minor, value_date ORDER BY arrival_seq) AS before FROM k)
        SELECT a.event_id, {_ONE.format(same='a.content_key = b.content_key')} AS one_payment FROM n a JOIN k b ON b.event_id = a.before""",
    "id_match": _L + """, i AS (SELECT *, CASE WHEN source_id IS NOT NULL THEN 'id-' || (event_id // 500) END AS sid FROM l),
        f AS (SELECT account_id, source, sid, min(arrival_seq) AS match_id FROM i WHERE sid IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1)
        SELECT i.event_id, f.match_id FROM i JOIN f ON f.account_id = i.account_id AND f.source = i.source AND f.sid = i.sid WHERE i.arrival_seq > f.match_id""",
    "source_connections": "SELECT DISTINCT t.account_id, t.source, a.connection_id FROM transactions t JOIN raw_artefacts a ON a.digest = t.artefact_digest WHERE a.connection_id IS NOT NULL AND a.connection_id <> ''",
    "walk_convention": """WITH r AS (SELECT l_orderkey AS account_id, l_linenumber AS pos, CAST(floor(sum(l_quantity)) AS BIGINT) AS amount FROM lineitem GROUP BY 1, 2),
        t AS (SELECT *, sum(amount) OVER (PARTITION BY account_id ORDER BY pos) * CASE WHEN account_id % 3 = 0 THEN -1 ELSE 1 END AS balance FROM r),
        s AS (SELECT *, balance - lag(balance) OVER w AS step, lag(amount) OVER w AS prior FROM t WINDOW w AS (PARTITION BY account_id ORDER BY pos)),
        c AS (SELECT account_id, count(*) AS steps, count(*) FILTER (step = amount) AS a, count(*) FILTER (step = -amount) AS b, count(*) FILTER (step = -prior) AS c, count(*) FILTER (step = prior) AS d FROM s WHERE step IS NOT NULL GROUP BY 1)
        SELECT account_id, steps, greatest(a, b, c, d) AS explained, CASE greatest(a, b, c, d) WHEN a THEN 'forward' WHEN b THEN 'forward_flipped' WHEN c THEN 'backward' ELSE 'backward_flipped' END AS convention FROM c""",
    "shape_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS path, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS low, max(CAST({c} AS VARCHAR)) AS high, "
        f"CAST(min(length(CAST({c} AS VARCHAR))) AS INTEGER) AS shortest, CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS longest, count(DISTINCT {c}) <= 10 AS categorical FROM raw_artefacts"
        for c in ("source", "account_ref", "media_type", "origin", "record_count", "connection_id")
    ),
    "presence_links": "SELECT kind AS category, count(*) AS n, count(transfer_id) > 0 AS always FROM planted_events GROUP BY 1 HAVING count(*) >= 5 AND count(transfer_id) IN (0, count(*))",
    "dead_rules": """WITH r(rule_no, needle) AS (VALUES (2, 'steel'), (3, 'a'), (4, 'nothing-has-this')),
        h AS (SELECT p_partkey, min(rule_no) AS rule_no FROM part JOIN r ON contains(lower(p_name || ' ' || p_type), needle) GROUP BY 1)
        SELECT r.rule_no, needle, count(h.p_partkey) AS hits FROM r LEFT JOIN h ON h.rule_no = r.rule_no GROUP BY 1, 2""",
    "alert_edges": """WITH e AS (SELECT 'conn-' || (user_id % 97) AS key, ts >= TIMESTAMP '2024-01-12' AS late, count(*) AS rung FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-14' GROUP BY 1, 2),
        b AS (SELECT * FROM e WHERE NOT late), n AS (SELECT * FROM e WHERE late)
        SELECT coalesce(b.key, n.key) AS key, CASE WHEN n.rung IS NULL THEN 'resolved' WHEN b.rung IS NULL OR n.rung > b.rung THEN 'announced' ELSE 'silent' END AS edge FROM b FULL JOIN n ON n.key = b.key""",
    "rebuild_diff": _L + """, c AS (SELECT account_id, count(*) FILTER (value_date < DATE '2024-01-10') AS b, count(*) FILTER (value_date >= DATE '2024-01-20') AS a FROM l GROUP BY 1)
        SELECT account_id, b AS rows_before, a AS rows_after, CASE WHEN a = 0 THEN 'vanished' WHEN b = 0 THEN 'new' WHEN a = b THEN 'same' ELSE 'changed' END AS state FROM c WHERE a + b > 0""",
    "orphan_rows": "SELECT DISTINCT entity_id, artefact_digest FROM transactions t WHERE artefact_digest <> '' AND NOT EXISTS (SELECT 1 FROM raw_artefacts a WHERE a.digest = t.artefact_digest)",
    "mask_text": f"""SELECT DISTINCT event_id, array_to_string(list_transform(regexp_extract_all(description, '[0-9A-Za-z]+|[^0-9A-Za-z]+'), lambda w: CASE WHEN lower(w) IN ({_FURNITURE}) THEN w
        WHEN regexp_full_match(w, '[0-9]+(?i:CR|DR)') THEN regexp_replace(regexp_extract(w, '^[0-9]+'), '[0-9]', '9', 'g') || regexp_extract(w, '[A-Za-z]+$') ELSE {_HIDE.format('w')} END), '') AS masked FROM planted_events""",
    "budget_payload": _K + "SELECT event_id, account_id, content_key || ':' || occurrence AS imported_id, description AS payee, amount_minor, status <> 'pending' AS cleared FROM k",
    "duplicate_ids": _K + "SELECT account_id, content_key || ':' || occurrence AS imported_id, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1",
    "propagation": """WITH r AS (SELECT DISTINCT event_id, amount_minor, upper(trim(regexp_replace(regexp_replace(description, '[0-9*#]+', '', 'g'), '\\s+', ' ', 'g'))) AS g, CASE WHEN event_id % 3 = 0 THEN kind END AS label FROM planted_events),
        m AS (SELECT a.event_id, s.label FROM r a JOIN r s ON s.g = a.g AND s.label IS NOT NULL AND sign(s.amount_minor) = sign(a.amount_minor) AND abs(a.amount_minor - s.amount_minor) * 10 <= abs(s.amount_minor) WHERE a.label IS NULL)
        SELECT event_id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS target, count(DISTINCT label) > 1 AS contested FROM m GROUP BY 1""",
    "statement_lines": r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE regexp_matches(lower(trim(source)), '^statement') AND text IS NOT NULL),
        l AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS line_no FROM d),
        s AS (SELECT *, greatest(sum(CASE WHEN regexp_matches(text, '(?i)page\s+1\s+of\s+\d+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS section,
          regexp_extract(text, '^\s*(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(.+?)\s+([\d,]+\.\d{2})\s*(CR)?(?:\s+-?[\d,]+\.\d{2})?\s*$', ['d', 'm', 't', 'a', 'c']) AS g FROM l)
        SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS INTEGER) AS position, g.t AS description,
          CAST(CAST(replace(g.a, ',', '') AS DECIMAL(20, 2)) * 100 AS BIGINT) * CASE WHEN g.c = 'CR' THEN 1 ELSE -1 END AS amount_minor FROM s WHERE g.d <> ''""",
}
