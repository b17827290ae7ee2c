"""Encoding a corpus with a public byte-level BPE, as a streaming transducer with bounded lookahead, and decoding it again.

A sequence of tokens is the encoding of its bytes exactly when every two neighbours stay apart under the merge list. So the last token
of a prefix's encoding can be found from the last tokens of shorter prefixes: it is the one vocabulary suffix that stays apart from the
token before it. No token is longer than ``Merges.lookahead`` bytes, hence only that many prefixes can still be continued; what all of
them share is stable and leaves the transducer. Memory is bounded by the lookahead, time is linear in the text, however long a run is.

Edge cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; lone surrogates (which no
valid UTF-8 column holds) are encoded as U+FFFD; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"

# Fixed value: the published split pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids are kept; beyond that the memory is emptied, so a worker's size does not follow the corpus.
PIECES_KEPT = 200_000
#: Bytes up to which a piece is remembered at all.
PIECE_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that the published vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        raw = {word: bytes(letters[c] for c in word) for pair in merges for word in (*pair, pair[0] + pair[1])}
        raw |= {c: bytes([b]) for c, b in letters.items()}
        self.ids = {data: vocabulary[word] for word, data in raw.items()}
        self.bytes = {i: data for data, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank and parts of the merge that makes it
        for k, (a, b) in enumerate(merges):
            pair = vocabulary[a], vocabulary[b]
            self.rank[pair] = k
            self.made.setdefault(vocabulary[a + b], (k, *pair))
        #: No vocabulary entry spans more bytes, so no later byte can change what all prefixes of this many bytes share.
        self.lookahead = max(map(len, self.ids))
        self._apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str | Path) -> Merges:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other are never merged, nor their parts across the border."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            known = self._apart[left, right] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Undo the merges of both sides from the latest to the first. While the borders are a and b, the pair (a, b) would have been
        # merged if its rank comes before the merges that built the borders further (ties go to the left pair first).
        never = (1 << 30, 0)
        until = never
        a, b = left, right
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and (rank, 1) < until:
                return False
            ka = self.made[a][0] if a in self.made else -1
            kb = self.made[b][0] if b in self.made else -1
            if ka < 0 and kb < 0:
                return True
            if ka > kb or (ka == kb and ka >= 0):
                # The same merge on both sides happens left to right: the right one is undone first.
                if ka == kb:
                    until, b = (kb, 2), self.made[b][1]
                else:
                    until, a = (ka, 0), self.made[a][2]
            else:
                until, b = (kb, 2), self.made[b][1]


class Transducer:
    """Feeds bytes, gives tokens as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.window = bytearray()  # the bytes behind the last stable token
        self.last: list[tuple[int, int]] = []  # per prefix of the window: its last token and that token's start

    def push(self, data: bytes) -> Iterator[int]:
        m, ids = self.m, self.m.ids
        for byte in data:
            self.window.append(byte)
            end = len(self.window)
            chosen = None
            for start in range(max(0, end - m.lookahead), end):
                token = ids.get(bytes(self.window[start:end]))
                if token is not None and (start == 0 and self._follows(None, token) or start > 0 and self._follows(self.last[start - 1][0], token)):
                    chosen = (token, start)
                    break
            self.last.append(chosen or (ids[bytes([byte])], end - 1))
            if end >= 2 * m.lookahead:
                yield from self._stable()

    _before: int | None = None

    def _follows(self, left: int | None, token: int) -> bool:
        left = self._before if left is None else left
        return left is None or self.m.apart(left, token)

    def _chain(self, end: int) -> list[tuple[int, int]]:
        """(token, end) of the encoding of the window's first `end` bytes, from the back."""
        out = []
        while end > 0:
            token, start = self.last[end - 1]
            out.append((token, end))
            end = start
        return out

    def _stable(self) -> Iterator[int]:
        size = len(self.window)
        shared: set[int] | None = None
        for end in range(size - self.m.lookahead + 1, size + 1):
            ends = {e for _, e in self._chain(end)}
            shared = ends if shared is None else shared & ends
        cut = max(shared or {0})
        if cut:
            yield from (token for token, _ in reversed(self._chain(cut)))
            self._before = self.last[cut - 1][0]
            del self.window[:cut]
            self.last = [(token, start - cut) for token, start in self.last[cut:]]

    def close(self) -> Iterator[int]:
        """The rest of the encoding."""
        yield from (token for token, _ in reversed(self._chain(len(self.window))))
        self.window.clear()
        self.last.clear()
        self._before = None


class Pieces(dict):
    """Token ids by piece. Short pieces are remembered, within bounds; the others are worked out each time."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.merges.ids.get(data)
        run = Transducer(self.merges)
        found = (whole,) if whole is not None else (*run.push(data), *run.close())
        if len(data) <= PIECE_BYTES:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Encodes whole texts."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.split = regex.compile(PATTERN)
        self.pieces = Pieces(merges)

    def encode(self, text: str | None) -> array:
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split.findall(text)))) if text else 0


class Decoder:
    """Turns ids back into text as they come; a character leaves once its last byte is there."""

    def __init__(self, merges: Merges) -> None:
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.bytes[i] for i in ids))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file. It is kept in the interpreter: this module's globals arrive anew with every task."""
    kept = sys.__dict__.setdefault("_ledgerweave_encoders", {})
    if path not in kept:
        kept[path] = Encoder(Merges.load(path))
    return kept[path]


def vocabulary_path(tokenizers: str = TOKENIZERS, name: str = NAME) -> str:
    return f"{tokenizers}/{name}.json"


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1):
                flat.extend(encode(text.as_py()))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_texts(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens."""
    return documents.select("doc_id", "text").mapInArrow(_encoding(vocabulary_path(tokenizers, name)), "doc_id bigint, ids array<int>")


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            n = pa.array([count(text.as_py()) for text in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "source", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; 0 for an empty or null text."""
    return documents.select("doc_id", "source", "text").mapInArrow(_counting(vocabulary_path(tokenizers, name)), "doc_id bigint, source string, n_tokens bigint")


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path).merges
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                state = Decoder(merges)
                texts.append(state.push(ids.as_py() or ()) + state.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_ids(encoded: DataFrame, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``doc_id, text`` of encoded documents; '' for an empty or null list."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(vocabulary_path(tokenizers, name)), "doc_id bigint, text string")
