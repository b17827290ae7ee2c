"""Schemas that drift between files: versioned fingerprints, migration steps and every change against the documentation.

Each payload is profiled once (field names with counts by value class). Profiles collapse to schema fingerprints per source; changes
are worked out once per fingerprint and joined back. A :class:`SchemaRegistry` keeps versions and their migration steps (rename, default,
cast); renames are given, or derived from the fingerprints seen so far by :func:`derive_renames`.

Edge cases: unreadable payloads and payloads without records give nothing; null and empty values say nothing about a field's type;
documentation for an unknown source is empty, so all its fields are additions; repeated artefacts repeat their changes once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.artefacts import csv_table, decode, flat_fields, plain_header, read_records, unwrapped
from ..store import BatchFolder

PROFILE = (
    "arrival_seq bigint, source string, fetched_at timestamp, kind string, n_records int, "
    "fields array<struct<name: string, present: int, nonnull: int, classes: map<string, int>>>"
)

# The classes of values that fit a documented type. Types not listed here fit everything.
FITTING = {
    "string": ("text", "instant"),
    "integer": ("int",),
    "number": ("int", "float"),
    "boolean": ("bool",),
    "iso timestamp": ("instant",),
    "object": ("object",),
    "array of objects": ("array", "object"),
    "decimal, 2 places": ("cell decimal",),
    "date dd/mm/yyyy": ("cell date",),
    "time hh:mm:ss": ("cell time",),
}

_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
_DECIMAL = re.compile(r"[+-]?\d+\.\d{2}$")
_DATE = re.compile(r"(\d{1,2})/(\d{1,2})/\d{4}$")
_TIME = re.compile(r"\d{1,2}:\d{2}:\d{2}$")


def value_class(value: object, cell: bool) -> str | None:
    """The class of a JSON value or of a file cell; None when it is null or blank."""
    if value is None:
        return None
    if not isinstance(value, str):
        return {bool: "bool", int: "int", float: "float", dict: "object", list: "array"}[type(value)]
    text = value.strip()
    if not text:
        return None
    if not cell:
        return "instant" if _INSTANT.match(text) else "text"
    if _DECIMAL.match(text):
        return "cell decimal"
    if m := _DATE.match(text):
        return "cell date" if 1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12 else "cell other date"
    return "cell time" if _TIME.match(text) else "cell text"


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for seq, source, at, payload in pdf[["arrival_seq", "source", "fetched_at", "payload"]].itertuples(index=False):
            text = decode(payload)
            found = read_records(text)
            if not found or not found[1]:
                continue
            kind, records = found
            # Fields of files are told by their headers as printed; values are looked up under the plain header.
            printed = {plain_header(c): c for c in reversed(csv_table(text)[0])} if kind == "csv" else {}
            present: Counter[str] = Counter()
            classes: dict[str, Counter[str]] = {}
            for record in records:
                for name, value in flat_fields(record) if kind == "json" else record.items():
                    present[name] += 1
                    c = value_class(value, kind != "json")
                    if c:
                        classes.setdefault(name, Counter())[c] += 1
            fields = [
                {"name": printed.get(n, n), "present": k, "nonnull": sum(classes.get(n, {}).values()), "classes": dict(classes.get(n, {}))}
                for n, k in sorted(present.items())
            ]
            out.append((seq, source, at, kind, len(records), fields))
        yield pd.DataFrame(out, columns=["arrival_seq", "source", "fetched_at", "kind", "n_records", "fields"])


def profiles(artefacts: DataFrame) -> DataFrame:
    """The field profile of every readable artefact that has records."""
    return artefacts.select("arrival_seq", "source", "fetched_at", "payload").mapInPandas(_profile, PROFILE)


def documented(schemas: DataFrame) -> DataFrame:
    """``source, docs``: the documented fields of a source with the value classes that fit them. The table is small and fixed."""
    cases = F.lit(None).cast("array<string>")
    for name, classes in FITTING.items():
        cases = F.when(F.col("field_type") == name, F.array(*map(F.lit, classes))).otherwise(cases)
    doc = F.struct(
        F.col("field_name").alias("name"),
        F.lower(F.trim("field_name")).alias("key"),
        F.coalesce("optional", F.lit(False)).alias("optional"),
        (F.col("field_type") == "array of objects").alias("closed"),
        cases.alias("fits"),
    )
    return schemas.where("field_name IS NOT NULL").groupBy(F.col("source").alias("_source")).agg(F.collect_set(doc).alias("docs"))


def fingerprints(profile_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Profiles with their schema fingerprint and how it differs from the documentation.

    Columns: ``arrival_seq, source, fetched_at, fingerprint, undocumented, missing, retyped``. File headers compare without letter
    case and blanks; fields under a documented array are not looked at.
    """
    joined = profile_rows.join(docs, F.col("source") == F.col("_source"), "left").drop("_source")
    joined = joined.withColumn("docs", F.expr("coalesce(docs, array())"))
    key = "if(kind = 'csv', lower(trim(f.name)), f.name)"
    have = joined.withColumn("keys", F.expr(f"transform(fields, f -> {key})")).withColumn(
        "doc_keys", F.expr("transform(docs, d -> if(kind = 'csv', d.key, d.name))")
    )
    misfit = "aggregate(map_entries(f.classes), 0, (n, e) -> n + if(array_contains(d.fits, e.key), 0, e.value))"
    own = "if(kind = 'csv', d.key, d.name)"
    field_closed = "exists(docs, x -> x.closed AND startswith(f.name, concat(x.name, '.')))"
    doc_closed = "exists(docs, x -> x.closed AND startswith(d.name, concat(x.name, '.')))"
    return have.select(
        "arrival_seq",
        "source",
        "fetched_at",
        F.expr(f"array_sort(transform(filter(fields, f -> NOT array_contains(doc_keys, {key}) AND NOT {field_closed}), f -> f.name))").alias("undocumented"),
        F.expr(f"array_sort(transform(filter(docs, d -> NOT d.optional AND NOT array_contains(keys, {own}) AND NOT {doc_closed}), d -> d.name))").alias("missing"),
        F.expr(
            f"array_sort(transform(filter(docs, d -> d.fits IS NOT NULL AND NOT {doc_closed} AND "
            f"exists(fields, f -> {key} = {own} AND 2 * {misfit} > f.nonnull)), d -> d.name))"
        ).alias("retyped"),
    ).withColumn("fingerprint", F.sha2(F.to_json(F.struct("source", "undocumented", "missing", "retyped")), 256))


def tallied(marks: DataFrame) -> DataFrame:
    """Distinct fingerprints with what they say and how many artefacts carry each."""
    return marks.groupBy("fingerprint").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("artefacts"), F.min("fetched_at").alias("first_seen"),
        F.first("undocumented").alias("undocumented"), F.first("missing").alias("missing"), F.first("retyped").alias("retyped"),
    )


class SchemaRegistry:
    """Schema versions of every source with the migration steps of each, kept in a folder that only grows.

    A fingerprint becomes a version once, numbered within its source by first appearance, and its steps are decided then: from given renames,
    else from those decided before, else from all fingerprints seen so far. Later files add versions and evidence and never change an
    older version, so the answer for a file once read stands.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.folder = BatchFolder(spark, path or f"{shared_folder(spark)}/schemas-{uuid4().hex}")

    def versions(self) -> DataFrame:
        """``source, version, fingerprint, first_seen, undocumented, missing, retyped, applied`` of all versions."""
        return self.folder.read("versions")

    def register(self, marks: DataFrame, renames: DataFrame | None = None) -> DataFrame:
        """Take in the fingerprints of some artefacts; gives all versions."""
        new = tallied(marks).checkpoint()
        evidence, known = new.drop("first_seen"), None
        if self.folder.batches:
            known = self.versions()
            both = evidence.unionByName(self.folder.read("evidence"))
            evidence = both.groupBy("fingerprint").agg(F.first("source").alias("source"), F.sum("artefacts").alias("artefacts"), *[F.first(c).alias(c) for c in ("undocumented", "missing", "retyped")])
        if renames is not None:
            steps = chained(renames)
        else:
            steps = derive_renames(evidence)
            if known is not None:
                old = known.select("source", F.inline("applied")).distinct()
                taken = lambda name: old.select("source", name).distinct()
                steps = old.unionByName(steps.join(taken("old_name"), ["source", "old_name"], "left_anti").join(taken("new_name"), ["source", "new_name"], "left_anti").select(*old.columns))
        fresh = new
        if known is not None:
            fresh = new.join(known.select("fingerprint"), "fingerprint", "left_anti")
            top = known.groupBy(F.col("source").alias("_s")).agg(F.max("version").alias("_top"))
            fresh = fresh.join(top, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        else:
            fresh = fresh.withColumn("_top", F.lit(0))
        number = F.row_number().over(Window.partitionBy("source").orderBy("first_seen", "fingerprint"))
        numbered = fresh.withColumn("version", number + F.coalesce("_top", F.lit(0))).drop("_top")
        placed = applied_renames(numbered, steps).select("source", "version", "fingerprint", "first_seen", "undocumented", "missing", "retyped", "applied")
        self.folder.write(placed.coalesce(1), "versions")
        self.folder.write(new.select("fingerprint", "source", "artefacts", "undocumented", "missing", "retyped").coalesce(1), "evidence")
        self.folder.commit()
        return self.versions()


def migration_steps(versions: DataFrame) -> DataFrame:
    """The steps of every version as rows, in the order in which they are taken: ``source, version, step, kind, field_name, new_name``."""
    each = F.expr("""concat(
        transform(applied, a -> named_struct('kind', 'rename', 'field_name', a.old_name, 'new_name', a.new_name)),
        transform(filter(missing, m -> NOT exists(applied, a -> a.old_name = m)), m -> named_struct('kind', 'default', 'field_name', m, 'new_name', CAST(NULL AS string))),
        transform(retyped, r -> named_struct('kind', 'cast', 'field_name', r, 'new_name', CAST(NULL AS string))))""")
    return versions.select("source", "version", F.posexplode(each).alias("step", "s")).select("source", "version", "step", "s.*")


def derive_renames(versions: DataFrame, follows: float = 0.95, explains: float = 0.5) -> DataFrame:
    """Migration steps ``source, old_name, new_name`` that the fingerprints of a source bear out.

    An undocumented field took a documented one over when (nearly) every artefact that has it lacks the documented field (`follows`),
    it accounts for at least `explains` of the artefacts that lack it, and both sit in the same object. Each name is used once; the
    strongest pair wins.
    """
    parent = "regexp_extract({0}, '^(.*)[.][^.]*$', 1)"
    pairs = (
        versions.select("source", "artefacts", F.explode("undocumented").alias("new_name"), "missing")
        .select("source", "artefacts", "new_name", F.explode("missing").alias("old_name"))
        .where(f"{parent.format('new_name')} = {parent.format('old_name')}")
        .groupBy("source", F.lower(F.trim("new_name")).alias("new_key"), "old_name")
        .agg(F.sum("artefacts").alias("both"))
    )
    news = versions.select("source", "artefacts", F.explode(F.transform("undocumented", lambda x: F.lower(F.trim(x)))).alias("new_key")).groupBy("source", "new_key").agg(F.sum("artefacts").alias("with_new"))
    olds = versions.select("source", "artefacts", F.explode("missing").alias("old_name")).groupBy("source", "old_name").agg(F.sum("artefacts").alias("without_old"))
    scored = pairs.join(news, ["source", "new_key"]).join(olds, ["source", "old_name"])
    scored = scored.where((F.col("both") >= follows * F.col("with_new")) & (F.col("both") >= explains * F.col("without_old")))
    scored = scored.withColumn("_s", F.struct((F.col("both") * F.col("both") / (F.col("with_new") * F.col("without_old"))).alias("a"), "both", "new_key", "old_name"))
    ranked = scored.withColumn("_new", F.max("_s").over(Window.partitionBy("source", "new_key")))
    ranked = ranked.withColumn("_old", F.max("_s").over(Window.partitionBy("source", "old_name")))
    return ranked.where("_s = _new AND _s = _old").select("source", "old_name", F.col("new_key").alias("new_name"))


def chained(renames: DataFrame) -> DataFrame:
    """Rename steps with every chain of them closed: a name that took over a later name also took over what that one had."""
    steps = renames.select("source", "old_name", F.lower(F.trim("new_name")).alias("new_name")).distinct()
    held, n = steps, steps.count()
    while True:
        on = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.new_name") == F.lower(F.trim("b.old_name"))]
        more = held.alias("a").join(steps.alias("b"), on).select("a.source", "a.old_name", "b.new_name").where("lower(trim(old_name)) <> new_name")
        held = held.union(more).distinct().checkpoint()
        if (now := held.count()) == n:
            return held
        n = now


def applied_renames(versions: DataFrame, renames: DataFrame) -> DataFrame:
    """The fingerprints with their renames as ``applied``: the documented field is missing and the new name is there."""
    steps = renames.groupBy(F.col("source").alias("_source")).agg(F.collect_set(F.struct("old_name", "new_name")).alias("steps"))
    v = versions.join(steps, F.col("source") == F.col("_source"), "left").withColumn("steps", F.expr("coalesce(steps, array())"))
    return v.withColumn("applied", F.expr("filter(steps, s -> array_contains(missing, s.old_name) AND exists(undocumented, u -> lower(trim(u)) = s.new_name))"))


def changes(versions: DataFrame) -> DataFrame:
    """``fingerprint, field_name, change_kind`` of every version, by its migration steps."""
    return versions.select(
        "fingerprint",
        F.inline(
            F.expr("""array_distinct(concat(
              transform(filter(undocumented, u -> NOT exists(applied, s -> s.new_name = lower(trim(u)))), u -> named_struct('field_name', u, 'change_kind', 'added')),
              transform(filter(missing, m -> NOT exists(applied, s -> s.old_name = m)), m -> named_struct('field_name', m, 'change_kind', 'removed')),
              transform(applied, s -> named_struct('field_name', s.old_name, 'change_kind', 'renamed')),
              transform(retyped, r -> named_struct('field_name', r, 'change_kind', 'retyped'))))""")
        ),
    )


def schema_changes(artefacts: DataFrame, schemas: DataFrame, renames: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Every change of every artefact: ``arrival_seq, field_name, change_kind``, each artefact routed by its fingerprint to its version.

    The registry at `path` goes on where it stands; without a path it is a new one. Renames are decided by it unless given.
    """
    marks = fingerprints(profiles(artefacts), documented(schemas)).checkpoint()
    versions = SchemaRegistry(artefacts.sparkSession, path).register(marks, renames)
    return marks.select("arrival_seq", "fingerprint").join(changes(versions), "fingerprint").select("arrival_seq", "field_name", "change_kind").distinct()


RECORDS = (
    "arrival_seq bigint, source string, kind string, version int, record_no int, fields map<string, string>, typed string, delivered string, steps array<string>"
)

_MONEY = re.compile(r"\s*(?:([A-Za-z]{3})\s*|[£€$]\s*)?([+-]?)\s*[£€$]?(\d[\d,]*(?:\.\d+)?|\.\d+)\s*([A-Za-z]{3})?\s*")
_DAY = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?\s*(Z|[+-]\d{2}:?\d{2})?")
_PRINTED = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:[T ](\d{2}:\d{2}(?::\d{2})?))?")


_encode = json.JSONEncoder(ensure_ascii=False).encode


def _as_text(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else _encode(value)


def _instant(value: object) -> datetime | None:
    """An instant or day that is written in ISO, as dd/mm/yyyy or as seconds or milliseconds since 1970."""
    text = str(value).strip()
    try:
        if re.fullmatch(r"\d{9,14}", text):
            return datetime.fromtimestamp(int(text) / (1000 if len(text) > 11 else 1), timezone.utc)
        if m := _DAY.fullmatch(text):
            found = datetime.fromisoformat(f"{m[1]}-{m[2]}-{m[3]}T{m[4] or '00:00'}{m[5] or ''}")
            return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
        if m := _PRINTED.fullmatch(text):
            return datetime.fromisoformat(f"{m[3]}-{int(m[2]):02d}-{int(m[1]):02d}T{m[4] or '00:00'}").replace(tzinfo=timezone.utc)
    except (ValueError, OverflowError, OSError):
        pass
    return None


def cast_to(value: object, kind: str, cell: bool) -> object:
    """A value that has another type or format than documented in the documented one; None when no rule reads it.

    A whole number in a cell of two decimal places counts minor units, as in the common columns.
    """
    text = value.strip() if isinstance(value, str) else value
    if kind == "string":
        return _as_text(value)
    if kind in ("integer", "number", "decimal, 2 places"):
        if isinstance(value, (bool, dict, list)):
            return None
        if isinstance(text, str):
            m = _MONEY.fullmatch(text)
            if not m:
                return None
            amount = Decimal(m[2] + m[3].replace(",", ""))
        else:
            amount = Decimal(str(text))
        if not amount.is_finite():
            return None
        if kind == "integer":
            return int(amount) if amount == amount.to_integral_value() else None
        if kind == "number":
            return amount
        if cell and isinstance(text, str) and "." not in text:
            amount /= 100
        return amount.quantize(Decimal("0.01"), ROUND_HALF_UP)
    if kind == "boolean":
        return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(text).lower())
    if kind == "iso timestamp":
        at = None if isinstance(value, (bool, dict, list)) else _instant(value)
        return None if at is None else at.isoformat().replace("+00:00", "Z")
    if kind == "date dd/mm/yyyy":
        at = None if isinstance(value, (bool, dict, list)) else _instant(value)
        return None if at is None else f"{at.day:02d}/{at.month:02d}/{at.year:04d}"
    if kind == "time hh:mm:ss":
        m = re.fullmatch(r"(?:.*[T ])?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?Z?", str(text))
        return f"{int(m[1]):02d}:{m[2]}:{m[3] or '00'}" if m and int(m[1]) < 24 and int(m[2]) < 60 else None
    held = unwrapped(value)
    if kind == "object":
        return held if isinstance(held, dict) else None
    if kind == "array of objects":
        return held if isinstance(held, list) else [held] if isinstance(held, dict) else None
    return value


def _typed(value: object, kind: str | None, cell: bool) -> str:
    """JSON text of a value that fits its documented type."""
    if cell and kind == "decimal, 2 places" and isinstance(value, str):
        return str(Decimal(value.strip())) if value.strip() else "null"
    return str(value) if isinstance(value, Decimal) else _encode(value)


class Rules:
    """How the records of one schema version become as documented: `docs` has type and optionality of the source's documented fields in
    their order, `moves` the documented name of every new name (lower case)."""

    def __init__(self, docs: dict[str, tuple[str, bool]], moves: dict[str, str], cell: bool) -> None:
        self.moves, self.cell = moves, cell
        self.keys = {n.strip().lower(): n for n in docs} if cell else {}
        self.closed = tuple(f"{n}." for n, (kind, _) in docs.items() if kind == "array of objects") or ("\0",)
        self.docs = {n: d for n, d in docs.items() if not n.startswith(self.closed)}
        self.arrays = {n for n, (kind, _) in self.docs.items() if kind == "array of objects"}
        self.money = [n for n, (kind, _) in self.docs.items() if kind in ("decimal, 2 places", "number")]
        self.checked = [(n, kind, FITTING[kind]) for n, (kind, _) in self.docs.items() if kind in FITTING]

    def record(self, pairs: Iterable[tuple[str, object]]) -> tuple[dict[str, str | None], str, dict[str, str], list[str]]:
        """One record: rename steps, then defaults, then casts.

        Gives the fields as text and as JSON of the documented types, the cells as delivered that a cast changed or could not read, and the steps
        taken. A missing field gets null, a missing required currency the one of the record's amount, else GBP; an absent optional
        field is no step. Of two cells of one name the first that says something counts; a single object where an array is documented
        becomes its only element.
        """
        cell, out, steps = self.cell, {}, []
        for name, value in pairs:
            if name.startswith(self.closed):
                continue
            if name in self.arrays and isinstance(value, dict):
                value = [value]
            key = name.strip().lower()
            own = self.moves.get(key) or self.keys.get(key) or name
            if own in out and value_class(out[own], cell) is not None:
                if own == name or name in out:
                    continue
                own = name
            elif key in self.moves:
                steps.append(f"rename {name} to {own}")
            out[own] = value
        code = None
        for name in self.money:
            if code is None and isinstance(out.get(name), str) and (m := _MONEY.fullmatch(out[name])):
                code = (m[1] or m[4] or "").upper() or None
        for name, (_, optional) in self.docs.items():
            if name not in out:
                out[name] = (code or "GBP") if not optional and name.rpartition(".")[2].lower() == "currency" else None
                if not optional:
                    steps.append(f"default {name}")
        delivered: dict[str, str] = {}
        for name, kind, fits in self.checked:
            value = out[name]
            if value is not None and (c := value_class(value, cell)) is not None and c not in fits:
                out[name], delivered[name] = cast_to(value, kind, cell), _as_text(value)
                steps.append(f"cast {name} to {kind}" if out[name] is not None else f"unread {name}")
        typed = ", ".join([f"{_encode(n)}: {_typed(v, self.docs[n][0] if n in self.docs else None, cell)}" for n, v in out.items()])
        fields = {n: v if v is None or isinstance(v, str) else str(v) if isinstance(v, Decimal) else _encode(v) for n, v in out.items()}
        return fields, f"{{{typed}}}", delivered, steps


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, Rules] = {}
    for pdf in batches:
        out = []
        for seq, source, payload, version, docs, moves in pdf[["arrival_seq", "source", "payload", "version", "docs", "moves"]].itertuples(index=False):
            found = read_records(decode(payload))
            if not found:
                continue
            cell = found[0] != "json"
            if (docs, moves, cell) not in known:
                held = sorted(json.loads(docs), key=lambda d: d.get("no", 0)) if docs else ()
                steps = {m["new_name"]: m["old_name"] for m in json.loads(moves)} if moves else {}
                known[docs, moves, cell] = Rules({d["name"]: (d.get("kind", ""), d["optional"]) for d in held}, steps, cell)
            rules = known[docs, moves, cell]
            for k, record in enumerate(found[1]):
                fields, typed, delivered, steps = rules.record(record.items() if cell else flat_fields(record))
                out.append((seq, source, found[0], version, k, fields, typed, _encode(delivered), steps))
        yield pd.DataFrame(out, columns=["arrival_seq", "source", "kind", "version", "record_no", "fields", "typed", "delivered", "steps"]).astype({"version": "Int32"})


def consistent_records(artefacts: DataFrame, schemas: DataFrame, renames: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """One table of all records: each brought from its schema version to the documentation by renames, then defaults, then casts.

    Gives ``arrival_seq, record_no, source, version`` (of the source's schema), ``fields`` (text by documented names, every documented
    field outside arrays, additions kept), ``typed`` (the same as JSON of the documented types), ``delivered`` (cells as they came that
    a cast changed or could not read), ``steps`` (in the order taken) and the common columns ``value_date, amount_minor`` (money out
    negative as the source signs it), ``currency, description, counterparty``. A cell that no cast rule reads is null in ``fields``
    and in its common column and stays in ``delivered``.
    """
    marks = fingerprints(profiles(artefacts), documented(schemas)).checkpoint()
    versions = SchemaRegistry(artefacts.sparkSession, path).register(marks, renames)
    routed = marks.select("arrival_seq", "fingerprint").join(versions.select("fingerprint", "version", F.to_json("applied").alias("moves")), "fingerprint")
    routed = routed.groupBy(F.col("arrival_seq").alias("_seq")).agg(F.min("version").alias("version"), F.min_by("moves", "version").alias("moves"))
    doc = F.struct(F.col("field_name").alias("name"), F.col("field_type").alias("kind"), F.coalesce("optional", F.lit(False)).alias("optional"), F.col("field_no").alias("no"))
    docs = schemas.where("field_name IS NOT NULL").groupBy(F.col("source").alias("_d")).agg(F.to_json(F.array_sort(F.collect_set(doc))).alias("docs"))
    rows = artefacts.select("arrival_seq", "source", "payload").join(routed, F.col("arrival_seq").eqNullSafe(F.col("_seq")), "left").join(docs, F.col("source") == F.col("_d"), "left")
    rows = rows.select("arrival_seq", "source", "payload", "version", "docs", "moves").mapInPandas(_records, RECORDS)
    rows = rows.withColumn("delivered", F.from_json("delivered", "map<string,string>"))
    cell = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.expr(f"coalesce(try_element_at(delivered, '{k}'), try_element_at(fields, '{k}'))")), F.lit("")) for k in keys])
    day, money = cell("Date", "D", "timestamp", "transactionTime"), cell("Amount", "Amount (GBP)", "T", "amount")
    epoch = F.when(day.rlike("^[0-9]{9,}$"), F.when(F.length(day) > 11, day.try_cast("bigint") / 1000).otherwise(day.try_cast("bigint")))
    read_day = F.coalesce(
        F.try_to_date(F.regexp_extract(day, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(day, r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", 1), "d/M/yyyy"), F.to_date(F.timestamp_seconds(epoch))
    )
    digits = F.regexp_replace(money, r"[^0-9.\-]", "")
    pence = F.when((F.col("kind") != "json") & ~F.contains(digits, F.lit(".")), digits.try_cast("bigint")).otherwise((digits.try_cast("decimal(20,2)") * 100).cast("bigint"))
    minor = cell("amount.minorUnits").try_cast("bigint")
    signed = F.when(F.upper(cell("direction")) == "OUT", -minor).otherwise(minor)
    return rows.select(
        "arrival_seq", "record_no", "source", "version", "fields", "typed", "delivered", "steps", read_day.alias("value_date"),
        F.when(minor.isNotNull(), signed).otherwise(pence).alias("amount_minor"),
        F.upper(F.coalesce(cell("Currency", "currency", "amount.currency"), F.lit("GBP"))).alias("currency"),
        cell("description", "Description", "reference", "Reference", "M").alias("description"),
        cell("counterPartyName", "Counter Party", "merchant_name", "meta.provider_merchant_name", "Name", "P").alias("counterparty"),
    )
