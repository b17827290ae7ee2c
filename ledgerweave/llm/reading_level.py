"""How demanding each text is, by harmonic propagation over a graph of sentences and words.

Nodes are the sentences of all documents and of the graded examples, and their words and word pairs (hashed to ``BUCKETS`` nodes, so the
word side has a fixed size whatever the corpus). Graded sentences are clamped to their band. In turn every word takes the mean of its
sentences, a graded sentence counting ``GRADED_MASS`` times and all free ones together at most ``FREE_MASS`` times, and every free sentence the weighted mean of its words, where words that
occur in few bands weigh more. This goes on until the word scores have settled: their mean change by sentences falls below
``TOLERANCE``. An iteration reads the encoded corpus once: each task adds up its words' sums before the shuffle, and only the word vector
(at most ``BUCKETS`` rows) travels to the driver and back.

A sentence is running English prose if it has two different words of two letters or more and either at least half of its words and pairs are known from
the graded examples or it is built with English function words as prose is; words it brings get their score by propagation. A document's level is the mean over its prose by length; its hard share is the length of prose of band 4 or 5 over the length of all of it.

Edge cases: null, empty and blank texts have no sentences: level null, shares 0; texts without prose likewise; without graded examples all
levels are null; graded rows without band or text are ignored; repeated texts get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Nodes of the word side.
BUCKETS = 1 << 18
#: What one graded sentence weighs.
GRADED_MASS = 50.0
#: How much all free sentences of a word may weigh together: however large the corpus, it cannot drown the examples.
FREE_MASS = 25.0
#: The mean change of a word's score, weighted by its sentences, below which propagation has settled.
TOLERANCE = 0.01
#: Words and share of function words from which a sentence is built as English prose is, and how many different ones it has.
PROSE_WORDS, FUNCTION_SHARE, FUNCTION_WORDS = 8, 0.35, 4
#: The score from which a sentence is of band 4 or 5.
HARD = 3.5
#: The most graded examples used (each is a labelled sample row).
GRADED_BOUND = 100_000
#: Sentence patterns whose words are remembered by a worker.
KEPT = 50_000

_SENTENCE = re.compile(r"(?<=[.!?;])\s+|[\r\n]+")
_NUMBER = re.compile(r"[£$€]?\d[\d.,]*")
_WORD = re.compile(r"[a-z']+")

# Common English function words that are no common words of neighbouring languages.
ENGLISH = frozenset(
    "about after again all although and any anyone are as because been before being both but by can could did do does each either every few for from had has have he her here him his how if into is it its itself "
    "just may might more most must my neither no nor not nothing of once only or other our ours own perhaps shall she should since some such than that the their them then there these they this those though through "
    "to too under until unless upon very was we were what when where whether which while who whom whose why will with within without would yet you your".split()
)

ENCODED = "doc_id bigint, chars array<int>, counts array<int>, english array<boolean>, feats array<int>"


def sentences(text: str) -> list[str]:
    """Pieces between sentence ends, semicolons and line ends."""
    return [u for u in _SENTENCE.split(text) if u and not u.isspace()]


def features(sentence: str) -> list[int]:
    """The nodes of a sentence's words and neighbouring word pairs, each once; numbers do not count."""
    return _features(sentence)[0]


def _features(sentence: str) -> tuple[list[int], bool]:
    """The nodes of a sentence and whether it is built as English prose is."""
    words = _WORD.findall(_NUMBER.sub(" ", sentence.lower()))
    if len({w for w in words if len(w) > 1}) < 2:
        return [], False  # single letters are no prose
    named = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    english = False
    if len(words) >= PROSE_WORDS:
        common = [w for w in words if w in ENGLISH]
        english = len(common) >= FUNCTION_SHARE * len(words) and len(set(common)) >= FUNCTION_WORDS
    return [zlib.crc32(w.encode()) % BUCKETS for w in named], english


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, tuple[list[int], bool]] = {}
    for batch in batches:
        chars, counts, flags, feats, ends, feat_ends = [], [], [], [], [0], [0]
        for text in batch.column(1):
            for piece in sentences(text.as_py() or ""):
                pattern = _NUMBER.sub("0", piece)
                found = kept.get(pattern)
                if found is None:
                    found = _features(pattern)
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[pattern] = found
                chars.append(len(piece))
                counts.append(len(found[0]))
                flags.append(found[1])
                feats.extend(found[0])
            ends.append(len(chars))
            feat_ends.append(len(feats))
        lists = [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            for offsets, values, kind in ((ends, chars, pa.int32()), (ends, counts, pa.int32()), (ends, flags, pa.bool_()), (feat_ends, feats, pa.int32()))
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "chars", "counts", "english", "feats"])


def word_side(n: np.ndarray, total: np.ndarray, squares: np.ndarray, graded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, weight and whether it is graded of every word node, from the sums that its sentences sent. Plain arrays, for they travel."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(n > 0, total / n, 0.0).astype(np.float32)
        spread = np.where(n > 0, np.maximum(squares / n - score.astype(np.float64) ** 2, 0), 1.0)
    weight = np.where(n > 0, np.sqrt(np.minimum(n / GRADED_MASS, 5.0)) / (spread + 0.15), 0.0).astype(np.float32)
    return score, weight, graded


def levels(words: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray, feats: np.ndarray, english: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each sentence (nan without known words) and whether it is running prose."""
    scores, weights, graded = words
    unit = np.repeat(np.arange(len(counts)), counts)
    w = weights[feats]
    mass = np.bincount(unit, w, len(counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.bincount(unit, w * scores[feats], len(counts)) / np.where(mass > 0, mass, np.nan)
        known = np.bincount(unit, graded[feats], len(counts)) / np.maximum(counts, 1)
    return score, ((known >= 0.5) | english) & (counts >= 3) & ~np.isnan(score)


def graded_sums(graded: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What clamped sentences send to their words: count, sum and sum of squares, by ``GRADED_MASS``."""
    sums = np.zeros((3, BUCKETS))
    for band, text in graded:
        for piece in sentences(text):
            f = features(piece)
            for k, value in enumerate((1.0, band, band * band)):
                sums[k, f] += GRADED_MASS * value
    return sums[0], sums[1], sums[2]


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def _send(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        sums = np.zeros((3, BUCKETS))
        for batch in batches:
            counts, feats = _flat(batch, "counts"), _flat(batch, "feats")
            if not len(feats):
                continue
            score, prose = levels(words, counts, feats, _flat(batch, "english").astype(bool))
            score = np.where(prose, score, np.nan)  # only prose passes difficulty on
            each = np.repeat(score, counts)
            good = ~np.isnan(each)
            for k, value in enumerate((np.ones(good.sum()), each[good], each[good] ** 2)):
                sums[k] += np.bincount(feats[good], value, BUCKETS)
        node = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), *[pa.array(s[node]) for s in sums]], names=["node", "n", "total", "squares"])

    return run


def _judge(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            counts, feats, chars = _flat(batch, "counts"), _flat(batch, "feats"), _flat(batch, "chars").astype(float)
            docs = batch.num_rows
            doc = np.repeat(np.arange(docs), np.diff(batch.column(1).offsets.to_numpy()))
            score, prose = levels(words, counts, feats, _flat(batch, "english").astype(bool))
            whole = np.maximum(np.bincount(doc, chars, docs), 1)
            length = np.bincount(doc[prose], chars[prose], docs)
            level = np.bincount(doc[prose], (chars * np.nan_to_num(score))[prose], docs)
            hard = prose & (np.nan_to_num(score) >= HARD)
            with np.errstate(divide="ignore", invalid="ignore"):
                level = pa.array(level / length, pa.float64(), mask=length == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), level, pa.array(length / whole), pa.array(np.bincount(doc[hard], chars[hard], docs) / whole)],
                names=["doc_id", "level", "prose_share", "hard_share"],
            )

    return run


def reading_levels(documents: DataFrame, graded: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, level, prose_share, hard_share`` of every document, on the scale of the graded bands; propagated until changes fall below `tolerance`."""
    spark = documents.sparkSession
    examples = graded.where("band IS NOT NULL AND text IS NOT NULL").select("band", "text").distinct().limit(GRADED_BOUND).collect()
    clamped = graded_sums([(int(r[0]), r[1]) for r in examples])
    seen = clamped[0] > 0
    path = f"{shared_folder(spark)}/sentences-{uuid4().hex}"
    documents.select("doc_id", "text").mapInArrow(_encode, ENCODED).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.parquet(path)
    words = word_side(*clamped, seen)
    while True:
        shared = spark.sparkContext.broadcast(words)
        sent = encoded.mapInArrow(_send(shared), "node int, n double, total double, squares double").groupBy("node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).toPandas()
        sums = [c.copy() for c in clamped]
        node, n = sent["node"].to_numpy(), sent["n"].to_numpy()
        for k, name in enumerate(("n", "total", "squares")):
            sums[k][node] += sent[name].to_numpy() * (np.minimum(n, FREE_MASS) / np.maximum(n, 1e-9))
        fresh = word_side(*sums, seen)
        # Clamped examples pull every score towards a fixed point, so the changes shrink from one iteration to the next.
        change = float((np.abs(fresh[0] - words[0]) * sums[0]).sum() / max(sums[0].sum(), 1.0))
        words = fresh
        shared.destroy()
        if change < tolerance:
            break
    return encoded.mapInArrow(_judge(spark.sparkContext.broadcast(words)), "doc_id bigint, level double, prose_share double, hard_share double")


def demanding(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """``doc_id`` of the documents most of whose text is running prose of band 4 or 5."""
    return reading_levels(documents, graded).where("hard_share > 0.5").select("doc_id")
