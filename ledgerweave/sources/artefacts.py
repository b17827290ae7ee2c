"""Reading landed payloads: bytes in any compression and encoding to text, JSON documents and flat records.

The byte work (inflating, charset detection, tolerant CSV) has no built-in Spark expression, so it runs in Arrow batches;
everything after it is relational.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import zstandard
except ImportError:  # the other compressions still work
    zstandard = None

# The keys under which the sources put their records.
RECORD_KEYS = ("results", "feedItems", "savingsGoals")
CSV_DELIMITERS = (",", ";", "\t", "|")

JSON_TEXT = T.StructType().add("text", T.StringType()).add("depth", T.IntegerType())


def inflate(raw: bytes) -> bytes | None:
    """Undo compression, however often it was applied; None when a compressed body is damaged or holds itself."""
    while True:
        packed = raw
        try:
            if raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            elif raw[:3] == b"BZh":
                raw = bz2.decompress(raw)
            elif raw[:6] == b"\xfd7zXZ\x00":
                raw = lzma.decompress(raw)
            elif raw[:4] == b"\x28\xb5\x2f\xfd" and zstandard:
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
                try:
                    raw = zlib.decompress(raw)
                except zlib.error:
                    return raw  # text that begins with x
            else:
                return raw
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
            return None
        if raw == packed:
            return None


def decode(raw: bytes | None) -> str | None:
    """The payload's text, or None when it is null, empty, damaged or not text."""
    if not raw:
        return None
    data = inflate(bytes(raw))
    if not data:
        return None
    text = None
    try:
        if data[:3] == b"\xef\xbb\xbf":
            text = data[3:].decode("utf-8")
        elif data[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
            text = data.decode("utf-32")
        elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            text = data.decode("utf-16")
        elif len(data) >= 4 and data[1:2] == b"\x00" and data[3:4] == b"\x00":
            text = data.decode("utf-16-le")
        elif len(data) >= 4 and data[0:1] == b"\x00" and data[2:3] == b"\x00":
            text = data.decode("utf-16-be")
        else:
            text = data.decode("utf-8")
    except UnicodeDecodeError:
        try:
            text = data.decode("cp1252")
        except UnicodeDecodeError:
            return None
    text = text.lstrip("﻿")
    control = sum(text.count(chr(i)) for i in (*range(9), 11, *range(14, 32)))
    return None if control * 50 > len(text) else text


def load_json(text: str) -> Any:
    """The parsed document, or None when the text is no JSON."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def bracket_depth(text: str) -> int:
    """The nesting of brackets, serialised strings included; brackets in other strings count too."""
    b = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    step = ((b == 123) | (b == 91)).astype(np.int32) - ((b == 125) | (b == 93)).astype(np.int32)
    return int(np.cumsum(step).max(initial=0))


def levels(doc: Any) -> int:
    """The levels of a walk through a document: serialised strings opened, every object under a name counted as wrapped in an array.

    A string that only looks serialised counts by its opening brackets.
    """
    deepest, open_values = 0, [(doc, 0)]
    while open_values:
        value, level = open_values.pop()
        if isinstance(value, str):
            value = value.lstrip()
            if value[:1] not in ("{", "["):
                continue
            found = load_json(value)
            if not isinstance(found, (dict, list)):
                deepest = max(deepest, level + 2 * (value.count("{") + value.count("[")))
                continue
            value = found
        if isinstance(value, dict):
            deepest = max(deepest, level)
            for v in value.values():
                if isinstance(v, (dict, list, str)):
                    single = isinstance(v, dict) or (isinstance(v, str) and v.lstrip()[:1] == "{")
                    open_values.append((v, level + 1 + single))
        elif isinstance(value, list):
            deepest = max(deepest, level)
            open_values.extend((v, level + 1) for v in value if isinstance(v, (dict, list, str)))
    return deepest


def _json_text(payload: pd.Series) -> pd.DataFrame:
    out = []
    for raw in payload:
        text = decode(raw)
        text = text.strip() if text else None
        if text and text[0] == "{" and isinstance(doc := load_json(text), dict):
            out.append((text, max(levels(doc), bracket_depth(text) + 1)))
        else:
            out.append((None, None))
    return pd.DataFrame(out, columns=["text", "depth"], dtype=object)


def _payload_text(payload: pd.Series) -> pd.Series:
    return pd.Series([decode(raw) for raw in payload], dtype=object)


def json_text(payload: Column | str) -> Column:
    """``struct<text, depth>`` of a payload that is a readable JSON object, depth being the levels of a walk; null fields otherwise."""
    return F.pandas_udf(_json_text, JSON_TEXT)(payload)


def payload_text(payload: Column | str) -> Column:
    """Text of a payload in any compression and encoding."""
    return F.pandas_udf(_payload_text, T.StringType())(payload)


def is_collection(text: str) -> bool:
    t = text.strip()
    return len(t) > 1 and (t[0], t[-1]) in (("{", "}"), ("[", "]"))


def unwrapped(value: Any) -> Any:
    """A string that holds a serialised object or array counts as what it holds."""
    if isinstance(value, str) and is_collection(value):
        inner = load_json(value)
        if isinstance(inner, (dict, list)):
            return inner
    return value


def json_records(doc: Any) -> list[dict]:
    """Records of a feed document: under a record key, at the top or inside outer lists of pages."""
    found: list[dict] = []
    if isinstance(doc, dict):
        hit = False
        for key in RECORD_KEYS:
            if key in doc:
                hit = True
                rows = unwrapped(doc[key])
                rows = [rows] if isinstance(rows, dict) else rows
                if isinstance(rows, list):
                    found += [r for r in map(unwrapped, rows) if isinstance(r, dict)]
        if not hit:
            for value in doc.values():
                value = unwrapped(value)
                if isinstance(value, list):
                    for item in value:
                        found += json_records(unwrapped(item))
    return found


def flat_fields(record: dict, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted name, value) of a record; objects yield themselves and their fields, arrays stay closed."""
    for key, value in record.items():
        value = unwrapped(value)
        name = f"{prefix}{key}"
        yield name, value
        if isinstance(value, dict):
            yield from flat_fields(value, f"{name}.")


def csv_table(text: str) -> tuple[list[str], list[list[str]]] | None:
    """Header cells as printed and data rows of a delimited text, whatever its delimiter and quoting; None when it is none."""
    lines = text.lstrip("﻿\r\n \t").splitlines()
    if not lines:
        return None
    delimiter = max(CSV_DELIMITERS, key=lambda d: lines[0].count(d))
    if not lines[0].count(delimiter):
        return None
    try:
        rows = [r for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter, skipinitialspace=False) if any(c.strip() for c in r)]
    except csv.Error:
        return None
    if not rows:
        return None
    return rows[0], rows[1:]


def plain_header(cell: str) -> str:
    """A header cell without outer blanks and stray quotes."""
    return cell.strip().strip('"').strip()


def qif_records(text: str) -> list[dict[str, str]] | None:
    """Records of a QIF text, a trailing one without its end mark included; the last value of a letter wins."""
    lines = [ln.strip("\r") for ln in text.lstrip("﻿").splitlines()]
    lines = [ln for ln in lines if ln.strip()]
    if not lines or not re.match(r"\s*!type:", lines[0], re.I):
        return None
    records, now = [], {}
    for line in lines[1:]:
        line = line.strip()
        if line.startswith("^"):
            if now:
                records.append(now)
            now = {}
        elif not line.startswith("!"):
            now[line[:1]] = line[1:]
    if now:
        records.append(now)
    return records


def read_records(text: str | None) -> tuple[str, list[dict]] | None:
    """(kind, records) of a decoded payload: kind is json, qif or csv; None when the text is unreadable.

    CSV and QIF records are flat string dictionaries keyed by header name or letter.
    """
    if text is None or not text.strip():
        return None
    head = text.lstrip("﻿ \r\n\t")[:1]
    if head in "{[":
        doc = load_json(text)
        return ("json", json_records(doc)) if isinstance(doc, dict) else None
    if head == "!":
        found = qif_records(text)
        return None if found is None else ("qif", found)
    if head == "<":
        return None
    table = csv_table(text)
    if table is None:
        return None
    header, rows = [plain_header(c) for c in table[0]], table[1]
    return "csv", [dict(zip(header, (c.strip() for c in row))) for row in rows]


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
