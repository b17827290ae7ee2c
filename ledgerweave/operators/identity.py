"""Identity kept up over time: last writes, sightings, aliases, orphans, claims, annotations, bindings, labels and drift.

Edge cases: null keys name nothing and match nothing; repeated rows change nothing; ties go by sequence, then by value; empty inputs give
no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_id, slug


def upserted(rows: DataFrame) -> DataFrame:
    """One row per payment: the last write's facts, but the first write's account and first sighting, and an occurrence that stays while the content does."""
    first, last = F.struct("first_seen_at", "content_key", "occurrence"), F.struct("last_seen_at", "first_seen_at", "content_key", "occurrence", "status")
    newest = F.max_by(F.struct("amount_minor", "value_date", "status", "description", "content_key", "occurrence"), last)
    per = rows.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min_by("account_id", first).alias("account_id"), F.min_by(F.struct("content_key", "occurrence"), first).alias("o"), newest.alias("n"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.min("booking_date").alias("booking_date"))
    sticky = F.when(F.col("o.content_key") == F.col("n.content_key"), F.col("o.occurrence")).otherwise(F.col("n.occurrence"))
    return per.select("entity_id", "account_id", "n.amount_minor", "n.value_date", "n.status", "n.description", "n.content_key", sticky.alias("occurrence"), "booking_date", "first_seen_at", "last_seen_at")


def first_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-ignore: the first row of every key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def sightings(transactions: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Each payment with every source that saw it and the first day it did: ``entity_id, account_id, source, observed_date``.

    Sources come from the artefacts that carry its digest; a payment whose digest nobody holds counts as seen by its own source.
    """
    rows = transactions.select("entity_id", "account_id", F.col("source").alias("own"), "value_date", "artefact_digest").distinct()
    landed = artefacts.groupBy(F.col("digest").alias("artefact_digest"), "source").agg(F.min(F.to_date("fetched_at")).alias("fetched"))
    seen = rows.join(landed, "artefact_digest", "left")
    return seen.groupBy("entity_id", "account_id", F.coalesce("source", "own").alias("source")).agg(F.min(F.coalesce("fetched", "value_date")).alias("observed_date"))


def source_breakdown(transactions: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Per account and source: payments, those that another source saw too, and the first connection and name their artefacts landed under."""
    seen = sightings(transactions, artefacts)
    many = seen.groupBy("entity_id").agg(F.count_distinct("source").alias("k"))
    named = artefacts.groupBy(F.col("digest").alias("artefact_digest")).agg(F.min_by("connection_id", F.when(F.col("connection_id") != "", F.col("arrival_seq"))).alias("connection"))
    via = transactions.select("entity_id", "artefact_digest").distinct().join(named, "artefact_digest", "left").groupBy("entity_id").agg(F.min("connection").alias("connection"))
    return seen.join(many, "entity_id").join(via, "entity_id", "left").groupBy("account_id", "source").agg(
        F.count_distinct("entity_id").alias("payments"), F.count_distinct(F.when(F.col("k") > 1, F.col("entity_id"))).alias("corroborated"), F.count_distinct("connection").alias("connections")
    )


def orphans(registry: Mapping[str, tuple[DataFrame, str]], owners: DataFrame, owner_key: str) -> DataFrame:
    """References of every registered column that name no owner: ``reference, key``; null and empty ones are none."""
    known = owners.select(F.col(owner_key).alias("key")).where("key IS NOT NULL").distinct()
    out = None
    for name, (table, column) in registry.items():
        rows = table.select(F.lit(name).alias("reference"), F.col(column).alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out.join(known, "key", "left_anti").select("reference", "key")


def aliases(accounts: DataFrame, extendable: DataFrame) -> DataFrame:
    """``account_id, alias``: the canonical id and every provider's qualified name of it."""
    own = accounts.select("account_id", F.col("account_id").alias("alias"))
    return own.unionByName(extendable.where("account_id IS NOT NULL AND provider_ref IS NOT NULL").select("account_id", F.col("provider_ref").alias("alias"))).distinct()


def claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Identifier claims in a text: a full number, and the last four digits that it implies; 0 is the stronger."""
    digits = F.regexp_extract(F.col(text), r"(\d{4,})\D*$", 1)
    each = F.array(F.struct(F.lit(0).alias("strength"), F.lit("number").alias("kind"), F.when(F.length(digits) >= 6, digits).alias("value")), F.struct(F.lit(1).alias("strength"), F.lit("last four").alias("kind"), F.when(digits != "", F.right(digits, F.lit(4))).alias("value")))
    return rows.select(F.col(key).alias("key"), F.inline(each)).where("value IS NOT NULL").distinct()


def best_claims(left: DataFrame, right: DataFrame) -> DataFrame:
    """The strongest claim that two sides share: ``left_key, right_key, kind``."""
    met = left.withColumnRenamed("key", "left_key").join(right.withColumnRenamed("key", "right_key"), ["strength", "kind", "value"])
    return met.groupBy("left_key", "right_key").agg(F.min_by("kind", F.struct("strength", "kind")).alias("kind"))


def annotations(log: DataFrame) -> DataFrame:
    """What stands after a log of writes and forgets: ``entity_id, kind, value``.

    A write lands unless a higher rank stands; a forget (``forget`` true) clears what stands up to its rank and leaves higher ranks alone. So the
    last write of a rank counts unless a later forget of at least that rank came, and of the ranks that count the highest stands.
    """
    per = log.groupBy("entity_id", "kind", "rank").agg(F.max(F.when(~F.col("forget"), F.col("seq"))).alias("written"), F.max_by("value", F.when(~F.col("forget"), F.col("seq"))).alias("value"), F.max(F.when(F.col("forget"), F.col("seq"))).alias("forgotten"))
    w = Window.partitionBy("entity_id", "kind").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    live = per.withColumn("_f", F.max("forgotten").over(w)).where("written IS NOT NULL AND (_f IS NULL OR _f < written)")
    # A higher rank that stood when a lower one was written kept it from landing, even if it was forgotten later.
    return live.groupBy("entity_id", "kind").agg(F.max_by("value", "rank").alias("value"), F.max("rank").alias("rank"))


def apply_to_group(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Annotation writes of group decisions: every member of a decided group gets its category, or the mark that it is deferred."""
    kind = F.when(F.col("deferred"), "deferred").otherwise("category")
    return members.join(decisions, "group_key").select("entity_id", kind.alias("kind"), F.when(F.col("deferred"), "true").otherwise(F.col("category")).alias("value"))


def rekeyed(transactions: DataFrame, moved: DataFrame) -> DataFrame:
    """``old_id, new_id`` of payments whose account is bound anew (``account_id`` to ``new_account``): ids are functions of first sightings."""
    rows = transactions.join(moved, "account_id")
    cols = ("new_account", "source", "source_id", "content_key", "occurrence", "artefact_digest")
    return rows.select(F.col("entity_id").alias("old_id"), entity_id(*[F.nullif(F.col(c), F.lit("")) if c == "source_id" else F.col(c) for c in cols]).alias("new_id")).distinct()


def follow(table: DataFrame, column: str, renamed: DataFrame) -> DataFrame:
    """A table with one of its id columns taken along to the new ids."""
    steps = renamed.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return table.join(steps, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*table.columns)


def merge_bindings(bindings: DataFrame) -> DataFrame:
    """Bindings of canonical accounts to targets: the newest of each account; targets that several accounts then share are dropped altogether."""
    newest = bindings.groupBy("canonical_id").agg(F.max_by("target", F.struct("minted_at", "target")).alias("target"))
    return newest.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("target"))).where("_n = 1").drop("_n")


def roster(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """Accounts as declared only, seen only (unnamed) or both (syncing): ``account_id, state``."""
    both = declared.select("account_id", F.lit(True).alias("d")).distinct().join(seen.select("account_id", F.lit(True).alias("s")).distinct(), "account_id", "full")
    return both.select("account_id", F.when(F.col("d").isNull(), "unnamed").when(F.col("s").isNull(), "provision").otherwise("syncing").alias("state"))


def newest_sets(rows: DataFrame, key: str, member: str, order: Sequence[str]) -> DataFrame:
    """What joined and left between the newest and the one before of each key's sets: ``key, member, change``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = rows.select(key, *order).distinct().withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    held = rows.join(ranked, [key, *order]).groupBy(F.col(key).alias("key"), F.col(member).alias("member")).agg(F.max((F.col("_k") == 1).cast("int")).alias("now"), F.max((F.col("_k") == 2).cast("int")).alias("then"))
    several = ranked.where("_k = 2").select(F.col(key).alias("key"))
    return held.join(several, "key", "left_semi").where("now <> then AND member IS NOT NULL").select("key", "member", F.when(F.col("now") == 1, "joined").otherwise("left").alias("change"))


def display_labels(accounts: DataFrame, named: DataFrame) -> DataFrame:
    """``account_id, label``: the declared label, else the newest name a source gave, else the slug, else the id."""
    newest = named.where("name IS NOT NULL AND trim(name) <> ''").groupBy("account_id").agg(F.max_by("name", F.struct("observed_at", "name")).alias("name"))
    return accounts.join(newest, "account_id", "left").select("account_id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.trim("name"), "account_slug", "account_id").alias("label"))


def attribution_ladder(artefacts: DataFrame, listed: DataFrame, default: Mapping[str, str]) -> DataFrame:
    """``arrival_seq, connection, rung``: the connection recorded with an artefact, else the only one that lists its account, else the source's default."""
    one = listed.where("account_id IS NOT NULL AND connection IS NOT NULL").groupBy("account_id").agg(F.min("connection").alias("c"), F.count_distinct("connection").alias("n")).where("n = 1").select(F.col("account_id").alias("account_ref"), "c")
    known = F.create_map(*[F.lit(x) for kv in default.items() for x in kv]) if default else F.create_map(F.lit(""), F.lit(""))
    usual = F.try_element_at(known, F.coalesce("source", F.lit("")))
    own = F.nullif(F.col("connection_id"), F.lit(""))
    rung = F.when(own.isNotNull(), "recorded").when(F.col("c").isNotNull(), "listed").when(usual.isNotNull(), "default").otherwise("unknown")
    return artefacts.join(one, "account_ref", "left").select("arrival_seq", F.coalesce(own, "c", usual).alias("connection"), rung.alias("rung"))


def renamed_connection(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("connection_id", F.when(F.col("connection_id") == old, new).otherwise(F.col("connection_id")))


def declared(before: DataFrame, declare: DataFrame, forget: DataFrame) -> DataFrame:
    """Declared accounts after new declarations (the newest of an id counts) and after some were forgotten."""
    rows = before.unionByName(declare)
    newest = rows.groupBy("account_id").agg(F.max_by(F.struct(*[c for c in before.columns if c != "account_id"]), "declared_at").alias("_r")).select("account_id", "_r.*")
    return newest.join(forget.select("account_id").distinct(), "account_id", "left_anti").select(*before.columns)


def slug_suggestions(accounts: DataFrame) -> DataFrame:
    """A name per provider account: connection and title, or the kind in brackets where a title repeats within its connection."""
    title, kind = F.trim(F.substring_index("display", "(", 1)), F.trim(F.regexp_extract("display", r"\(([^)]*)\)?", 1))
    rows = accounts.select("provider_ref", "connection", title.alias("title"), kind.alias("kind")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("connection", "title"))
    named = rows.withColumn("_n", n).select("provider_ref", slug(F.concat_ws("-", "connection", F.when(F.col("_n") > 1, F.col("kind")).otherwise(F.col("title")))).alias("suggestion"))
    return named.where("suggestion <> ''").distinct()


def collisions(names: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Names that stand in several namespaces: ``name, spaces``."""
    out = None
    for space, (table, column) in names.items():
        rows = table.select(F.col(column).alias("name"), F.lit(space).alias("space")).where("name IS NOT NULL AND name <> ''").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("space")), ",").alias("spaces"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def stale(stamps: DataFrame, current: Column) -> DataFrame:
    """Derived layers whose stamp is missing or of another code than the current one: ``layer, stale``."""
    return stamps.select("layer", (F.col("stamp").isNull() | (F.col("stamp") != current)).alias("stale"))
