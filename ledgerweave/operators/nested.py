"""Deeply nested JSON payloads to flat child rows that keep the link to their parent.

Only the bytes-to-text step is Python. The walk is one projection: nested ``transform`` calls attach ancestor paths and positions,
``flatten`` joins the arrays of a level, ``inline`` emits rows. The number of levels comes from the data (the deepest walk, an
object under a name taken as an array of one), so no depth is cut off.

Edge cases: unreadable, empty and null payloads and payloads whose top is no object give no rows; null and scalar elements count in
positions but are no rows; a string that holds a serialised object or array counts as what it holds; an array name met as a single
object counts as element 0; an artefact row that stands there twice (landing numbers are unique) gives its rows twice; rows without a
landing number give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artefacts import json_text

# Levels that one projection unrolls; deeper payloads go on from a written frontier.
LEVELS_PER_PASS = 12
NODE = "struct<path: string, anchor: string, js: string, elem: boolean>"


def array_names(schemas: DataFrame) -> DataFrame:
    """``source, listed``: the last name parts of the arrays of objects that each source documents."""
    return (
        schemas.where("field_type = 'array of objects'")
        .groupBy(F.col("source").alias("_source"))
        .agg(F.collect_set(F.element_at(F.split("field_name", r"\."), -1)).alias("listed"))
    )


def _children(nodes: str) -> Column:
    """The nodes one level down. A node is ``path, anchor`` (nearest enclosing row), ``js`` (its text) and ``elem`` (it is an array element)."""
    return F.expr(f"""
        flatten(transform({nodes}, n -> CASE
          WHEN n.js LIKE '{{%' THEN transform(
            coalesce(map_entries(from_json(n.js, 'map<string,string>')), array()),
            e -> named_struct(
              'path', if(n.path = '', e.key, concat(n.path, '.', e.key)),
              'anchor', if(n.elem, n.path, n.anchor),
              'js', if(array_contains(listed, e.key) AND ltrim(e.value) LIKE '{{%', concat('[', e.value, ']'), ltrim(e.value)),
              'elem', false))
          WHEN n.js LIKE '[%' THEN transform(
            coalesce(from_json(n.js, 'array<string>'), array()),
            (v, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'anchor', n.anchor, 'js', ltrim(v), 'elem', true))
          ELSE CAST(array() AS array<{NODE}>) END))""")


def _open(nodes: str) -> Column:
    """Only nodes that can hold something: text that looks like an object or an array."""
    return F.expr(f"filter({nodes}, n -> n.js LIKE '{{%' OR n.js LIKE '[%')")


def nested_rows(artefacts: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per object that is an array element: ``arrival_seq, node_path, parent_path, table_path, js``.

    ``table_path`` is the path without positions, the name of the flat table the row belongs to.
    """
    decoded = artefacts.where("arrival_seq IS NOT NULL").select("arrival_seq", "source", json_text(F.col("payload")).alias("_json"))
    depth = decoded.agg(F.max("_json.depth")).first()[0] or 0
    state = (
        decoded.where("_json.text IS NOT NULL")
        .join(array_names(schemas), F.col("source") == F.col("_source"), "left")
        .select(
            "arrival_seq",
            F.coalesce("listed", F.array().cast("array<string>")).alias("listed"),
            F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("anchor"), F.col("_json.text").alias("js"), F.lit(False).alias("elem"))).cast(f"array<{NODE}>").alias("n0"),
        )
    )
    parts: list[DataFrame] = []
    left = max(depth, 1)
    while left > 0:
        step = min(left, LEVELS_PER_PASS)
        found = []
        for k in range(1, step + 1):
            state = state.withColumn(f"n{k}", _children(f"n{k - 1}")).withColumn(f"n{k}", _open(f"n{k}"))
            found.append(F.col(f"n{k}"))
        parts.append(state.select("arrival_seq", F.inline(F.filter(F.flatten(F.array(*found)), lambda n: n["elem"] & n["js"].startswith("{")))))
        left -= step
        if left > 0:
            state = state.select("arrival_seq", "listed", F.col(f"n{step}").alias("n0")).where("size(n0) > 0").checkpoint()
            if state.isEmpty():
                break
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.where(F.expr("from_json(js, 'map<string,string>') IS NOT NULL")).select(
        "arrival_seq",
        F.col("path").alias("node_path"),
        F.col("anchor").alias("parent_path"),
        F.regexp_replace("path", r"\[\d+\]", "").alias("table_path"),
        "js",
    )


def child_table(rows: DataFrame, table_path: str, columns: dict[str, str]) -> DataFrame:
    """One flat table out of :func:`nested_rows`: keys of the row and its parent, the row's positions from the top, scalar fields by JSON path, and the whole record."""
    cells = [F.get_json_object("js", path).alias(name) for name, path in columns.items()]
    positions = F.transform(F.regexp_extract_all("node_path", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return rows.where(F.col("table_path") == table_path).select("arrival_seq", "node_path", "parent_path", positions.alias("positions"), *cells, F.col("js").alias("record"))


def documented_tables(schemas: DataFrame, record_keys: dict[str, str]) -> dict[str, dict[str, str]]:
    """Table path and scalar columns of every array of objects that the documentation names, records themselves included.

    `record_keys` tells under which key a source's records lie. The documentation is one short table.
    """
    tables: dict[str, dict[str, str]] = {}
    fields = schemas.where("field_name IS NOT NULL").select("source", "field_name", "field_type").distinct().collect()
    for source, key in record_keys.items():
        own = {r.field_name: r.field_type for r in fields if r.source == source}
        arrays = {n for n, kind in own.items() if kind == "array of objects"}
        for root in ("", *sorted(arrays)):
            inside = {n[len(root) + 1 :] if root else n for n in own if not root or n.startswith(f"{root}.")}
            scalars = sorted(n for n in inside if own[f"{root}.{n}" if root else n] not in ("object", "array of objects") and not any((f"{root}.{n}" if root else n).startswith(f"{a}.") for a in arrays if a != root and a.startswith(f"{root}." if root else "")))
            path = ".".join(filter(None, (key, root)))
            tables.setdefault(path, {}).update({n.replace(".", "_"): f"$.{n}" for n in scalars})
    return tables


def child_tables(artefacts: DataFrame, schemas: DataFrame, record_keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every documented flat table by its path, from one walk that is written once."""
    rows = nested_rows(artefacts, schemas).checkpoint()
    return {path: child_table(rows, path, columns) for path, columns in documented_tables(schemas, record_keys).items()}
