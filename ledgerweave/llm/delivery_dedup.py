"""Repeated deliveries, exact or nearly so, against everything already held and without reading held payloads again.

A payload becomes the sorted list of its records' content hashes (day, amount, occurrence; names for snapshot entries), so layout,
encoding, wording and volatile ids do not count. Winnowing that list with a window of two keeps the smaller hash of each
neighbouring pair. If two lists share four fifths of the larger one, at most two fifths of it are breaks between shared runs, so some
run has two neighbours and both lists keep the same hash of it: the prescreen loses nothing at the threshold of 0.8.

The store keeps what it holds in a folder: distinct record sets by batch, and their prints in segments, each cut into buckets of bounded
size with one Bloom filter a bucket. A new batch asks the filters; only buckets with a positive answer are read, only sets that share a
print are fetched, shared coverage is verified on their record hashes, and the batch adds itself as a new segment. Segments of a level are merged
when there are `FAN` of them, so filters to ask grow with the logarithm of the history. Exact copies collapse to one set before any
join. Per set the earliest holder of any of its prints is verified first; when it qualifies it is the answer, because no earlier set
shares a print. Only the rest compare with all holders, so a large group of near copies costs one comparison a member.

Edge cases: null, empty, unreadable payloads and payloads without records take no part; null account or source is a scope of its own;
ties in `fetched_at` go by `arrival_seq`, a null `fetched_at` counts as earliest; repeated rows of one `arrival_seq` count once; extra
columns are ignored; an empty input gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.artefacts import decode, read_records
from ..sources.records import day_and_amount, entry_name
from ..store import BatchFolder

THRESHOLD = 0.8
WINDOW = 2
#: Prints a bucket holds on average, and new prints that one task asks a filter about.
BUCKET_PRINTS = 1 << 18
#: Segments of one level that are merged into one of the next.
FAN = 8
BITS_PER_PRINT = 12
PROBES = 6

SIGNATURE = "arrival_seq bigint, scope bigint, at bigint, hashes array<bigint>, prints array<bigint>"


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def record_hashes(records: list[dict], scope: str) -> list[int]:
    """One hash per record in the canonical order of the records (by day, amount, name), equal records told apart by their number."""
    keys = []
    for record in records:
        day, amount = day_and_amount(record)
        keys.append((day or "", amount if amount is not None else -(1 << 62), "" if day or amount is not None else entry_name(record) or ""))
    seen: Counter = Counter()
    out = []
    for key in sorted(keys):
        seen[key] += 1
        out.append(_signed(f"{scope}\x1f{key}\x1f{seen[key]}"))
    return out


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """The smallest hash of every window of neighbours, each once; of a shorter list its smallest."""
    if len(hashes) <= window:
        return [min(hashes)] if hashes else []
    return sorted({min(hashes[i : i + window]) for i in range(len(hashes) - window + 1)})


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for seq, account, source, at, payload in pdf[["arrival_seq", "account_ref", "source", "at", "payload"]].itertuples(index=False):
            found = read_records(decode(payload))
            if found and found[1]:
                scope = "\x1f".join("\x00" if part is None else part for part in (account, source))
                hashes = record_hashes(found[1], scope)
                out.append((seq, _signed(scope), at, hashes, winnow(hashes)))
        yield pd.DataFrame(out, columns=["arrival_seq", "scope", "at", "hashes", "prints"])


def signatures(artefacts: DataFrame) -> DataFrame:
    """Record hashes and prints of every readable artefact with records."""
    rows = artefacts.select(
        "arrival_seq", "account_ref", "source", F.coalesce(F.unix_micros("fetched_at"), F.lit(-(1 << 62))).alias("at"), "payload"
    ).where("arrival_seq IS NOT NULL AND payload IS NOT NULL")
    return rows.mapInPandas(_sign, SIGNATURE)


def _positions(prints: np.ndarray, bits: int) -> np.ndarray:
    x = prints.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        y = x ^ (x >> np.uint64(31))
        y *= np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(29)
        y |= np.uint64(1)
        steps = np.arange(PROBES, dtype=np.uint64)[:, None]
        return (x[None, :] + steps * y[None, :]) % np.uint64(bits)


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    prints = pdf["print"].to_numpy()
    bits = max(64, -(-len(prints) * BITS_PER_PRINT // 8) * 8)
    field = np.zeros(bits, dtype=np.uint8)
    field[_positions(prints, bits).ravel()] = 1
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "bits": [np.packbits(field).tobytes()]})


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    prints = new["print"].to_numpy()
    held = np.zeros(len(prints), dtype=bool)
    for bits in filters["bits"]:
        packed = np.frombuffer(bits, dtype=np.uint8)
        at = _positions(prints, len(packed) * 8)
        held |= ((packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7)))) & np.uint64(1)).astype(bool).all(axis=0)
    return new.loc[held, ["segment", "bucket", "print"]]


def _shared(a: str, b: str) -> Column:
    """Shared coverage of two record sets: common records over the larger."""
    return F.expr(f"size(array_intersect({a}, {b})) / greatest(size({a}), size({b}))")


class FingerprintStore:
    """A persistent store of record sets, prints and Bloom filters in a shared folder, with one writer at a time.

    A batch counts once its commit marker is there; the marker names the live segments. A store opened again goes on after the last such
    batch; what an unfinished batch left is written anew, and committed tables are never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD, bucket_prints: int = BUCKET_PRINTS, fan: int = FAN) -> None:
        self.spark, self.threshold, self.bucket_prints, self.fan = spark, threshold, bucket_prints, fan
        self.folder = BatchFolder(spark, path)
        self._open()

    @property
    def batches(self) -> int:
        return self.folder.batches

    def _open(self) -> None:
        self.folder.batches = self.folder.completed()
        note = self.folder.note()
        #: Live segments as (folder, level, buckets), and into how many buckets each batch's sets are cut.
        self.segments: list[list] = note.get("segments", [])
        self.set_buckets: list[int] = note.get("set_buckets", [])

    def _buckets(self, rows: int) -> int:
        return max(1, -(-rows // self.bucket_prints))

    def _segment(self, prints: DataFrame, rows: int, level: int) -> list:
        """Write prints ``print, set_id, first, home`` as one segment of the batch that is being made."""
        n, name = self._buckets(rows), f"segment-{level}"
        placed = prints.withColumn("bucket", F.pmod("print", F.lit(n)).cast("int")).repartition("bucket")
        held = self.folder.write(placed, name, "bucket")
        filters = held.select("bucket", "print").distinct().groupBy("bucket").applyInPandas(_fill, "bucket int, bits binary")
        self.folder.write(filters, f"{name}-filters")
        return [f"{name}/batch={self.batches}", level, n]

    def _at(self, name: str) -> str:
        return f"{self.folder.path}/{name}"

    def _positives(self, prints: DataFrame, rows: int) -> DataFrame:
        """``segment, bucket, print`` of the new prints that a filter of the history claims to hold; a bucket's questions are cut into bounded chunks."""
        new, filters = None, None
        for k, (name, _, n) in enumerate(self.segments):
            chunks = self._buckets(-(-rows // n))
            asked = prints.select("print").distinct().select(F.lit(k).alias("segment"), F.pmod("print", F.lit(n)).cast("int").alias("bucket"), F.pmod(F.xxhash64("print"), F.lit(chunks)).cast("int").alias("chunk"), "print")
            path, _, batch = name.partition("/")
            told = self.spark.read.parquet(self._at(f"{path}-filters/{batch}")).select(F.lit(k).alias("segment"), "bucket", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "bits")
            new, filters = (asked, told) if new is None else (new.unionByName(asked), filters.unionByName(told))
        key = ["segment", "bucket", "chunk"]
        return new.groupBy(*key).cogroup(filters.groupBy(*key)).applyInPandas(_screen, "segment int, bucket int, print bigint")

    def _held_prints(self, positives: DataFrame) -> DataFrame | None:
        """The rows of the positive prints; only buckets with a positive are read. The list of buckets is short: one for `bucket_prints` prints."""
        wanted: dict[int, list[int]] = {}
        for r in positives.select("segment", "bucket").distinct().collect():
            wanted.setdefault(r.segment, []).append(r.bucket)
        out = None
        for k, buckets in sorted(wanted.items()):
            rows = self.spark.read.parquet(self._at(self.segments[k][0])).where(F.col("bucket").isin(*buckets)).drop("bucket")
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.join(positives.select("print").distinct(), "print", "left_semi")

    def _held_sets(self, wanted: DataFrame) -> DataFrame | None:
        """Record hashes of held sets ``home, held_id``; only the buckets they lie in are read."""
        counts = F.array(*map(F.lit, self.set_buckets))
        placed = wanted.withColumn("bucket", F.pmod("held_id", F.element_at(counts, F.col("home") + 1)).cast("int"))
        homes: dict[int, list[int]] = {}
        for r in placed.select("home", "bucket").distinct().collect():
            homes.setdefault(r.home, []).append(r.bucket)
        out = None
        for home, buckets in sorted(homes.items()):
            rows = self.spark.read.parquet(self._at(f"sets/batch={home}")).where(F.col("bucket").isin(*buckets)).select(F.col("set_id").alias("held_id"), F.col("hashes").alias("held_hashes"))
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.join(wanted.select("held_id").distinct(), "held_id", "left_semi")

    def add(self, signed: DataFrame) -> DataFrame:
        """Tie a batch of signatures to what is held and to its own earlier rows, then hold it too.

        Gives ``arrival_seq, repeats`` for the rows that repeat an earlier one. Batches are to come in the order of time.
        """
        self._open()
        write = self.folder.write
        order = F.struct("at", "arrival_seq")
        sets = (
            signed.groupBy("scope", "hashes")
            .agg(F.min(order).alias("first"), F.any_value("prints").alias("prints"))
            .select(F.xxhash64("scope", "hashes").alias("set_id"), "first", "hashes", "prints")
        )
        sets = write(sets, "new_sets")
        prints = write(sets.select("set_id", "first", F.explode("prints").alias("print")), "new_prints")
        n_prints = prints.count()
        mine = prints.select("print", F.col("set_id").alias("held_id"), F.col("first").alias("held_first"), F.lit(self.batches).alias("home"))
        old = self._held_prints(write(self._positives(prints, n_prints), "positives")) if self.segments else None
        holders = mine if old is None else mine.unionByName(old.select("print", F.col("set_id").alias("held_id"), F.col("first").alias("held_first"), "home"))
        holders = write(holders, "holders")
        known = sets.select(F.col("set_id").alias("held_id"), F.col("hashes").alias("held_hashes"))
        if old is not None:
            told = self._held_sets(holders.where(F.col("home") < self.batches).select("home", "held_id").distinct())
            known = known if told is None else known.unionByName(told)
        earliest = holders.groupBy("print").agg(F.min(F.struct("held_first", "held_id")).alias("held"))
        lead = (
            prints.join(earliest, "print")
            .where(F.col("held.held_first") < F.col("first"))
            .groupBy("set_id")
            .agg(F.min("held").alias("held"))
            .select("set_id", "held.held_id", "held.held_first")
        )
        own = sets.select("set_id", "first", "hashes")
        checked = write(
            lead.join(own, "set_id").join(known, "held_id").select("set_id", "first", "held_first", (_shared("hashes", "held_hashes") >= self.threshold).alias("ok")).distinct(), "leads"
        )
        rest = checked.where("NOT ok").select("set_id", F.col("held_first").alias("after"), "first")
        pairs = (
            prints.join(rest.select("set_id", "after"), "set_id")
            .join(holders, "print")
            .where((F.col("held_first") > F.col("after")) & (F.col("held_first") < F.col("first")))
            .select("set_id", "held_id", "held_first")
            .distinct()
        )
        wide = pairs.join(own, "set_id").join(known, "held_id").where(_shared("hashes", "held_hashes") >= self.threshold)
        tied = checked.where("ok").select("set_id", "held_first").unionByName(wide.select("set_id", "held_first")).groupBy("set_id").agg(F.min("held_first").alias("held_first"))
        tied = write(tied, "tied")
        # A copy repeats what its set repeats, else the set's first delivery.
        placed = signed.select("arrival_seq", "at", F.xxhash64("scope", "hashes").alias("set_id")).join(own.select("set_id", "first"), "set_id").join(tied, "set_id", "left")
        origin = F.coalesce("held_first", "first")
        found = write(placed.where(origin < order).select("arrival_seq", origin["arrival_seq"].alias("repeats")).distinct(), "found")
        # A set that the history already holds shares all its prints with itself, so it is among the holders; it brings nothing new.
        fresh = sets
        if old is not None:
            again = holders.where(F.col("home") < self.batches).select(F.col("held_id").alias("set_id")).distinct()
            fresh = sets.join(again, "set_id", "left_anti")
        n = self._buckets(sets.count())
        write(fresh.select("set_id", "first", "hashes", F.pmod("set_id", F.lit(n)).cast("int").alias("bucket")).repartition("bucket"), "sets", "bucket")
        new = prints.join(fresh.select("set_id"), "set_id", "left_semi").select("print", "set_id", "first", F.lit(self.batches).alias("home"))
        if not fresh.isEmpty():
            self.segments.append(self._segment(new, n_prints, 0))
            self._merge()
        self.set_buckets.append(n)
        self.folder.commit({"segments": self.segments, "set_buckets": self.set_buckets})
        return found

    def _merge(self) -> None:
        """Merge a level that is full into one segment of the next."""
        level = 0
        while len(full := [s for s in self.segments if s[1] == level]) >= self.fan:
            parts = [self.spark.read.parquet(self._at(name)).drop("bucket") for name, _, _ in full]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            merged = self._segment(whole, whole.count(), level + 1)
            self.segments = [s for s in self.segments if s[1] != level] + [merged]
            level += 1


def repeated_deliveries(artefacts: DataFrame, batches: int = 3, path: str | None = None) -> DataFrame:
    """Replay all artefacts in `batches` spans of time through one store: ``seq_a, seq_b``, the smaller number first.

    The store at `path` goes on where it stands: the artefacts are later ones, tied to what it holds too. Without a path it is a new one.
    """
    spark = artefacts.sparkSession
    path = path or f"{shared_folder(spark)}/deliveries-{uuid4().hex}"
    own = f"{path}/signed/run={uuid4().hex}"
    signatures(artefacts).write.parquet(own)
    signed = spark.read.parquet(own).dropDuplicates(["arrival_seq"])
    cuts = signed.where("at > -4000000000000000000").agg(F.percentile_approx("at", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    store, found = FingerprintStore(spark, path), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = signed if low is None else signed.where(F.col("at") > low)
        result = store.add(part if high is None else part.where(F.col("at") <= high))
        found = result if found is None else found.unionByName(result)
    return found.select(F.least("arrival_seq", "repeats").alias("seq_a"), F.greatest("arrival_seq", "repeats").alias("seq_b"))
