"""Packing token sequences by vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments (pieces) and tokens that bear loss.  Each task
packs its own rows: from a pool of open documents the sequence in work takes the one that
fits and whose size vector has the largest dot product with the room left; when none fits
whole, the longest one is cut to fill the room.  A sequence that ends short of the token
limit is dealt into sequences whose lengths are powers of two, which need no padding.
Nothing is shuffled and no task holds more than twice ``POOL`` open documents, or more than
``POOL_TOKENS`` open tokens beside the document that came last.

Null texts are empty; every document ends with ``end_id``, so an empty one is one token.
Repeated rows are packed one by one.  A column of prompt lengths (tokens at a document's
start that bear no loss) is optional; null means 0.  An empty table gives no pieces; other
columns are not read, whatever their names.  A text of any length is split whole, about
``SLICE`` bytes of texts at once, and its ids are held until its last piece is cut.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, SEGMENTS, END_ID = 4096, 512, 2
POOL, POOL_TOKENS = 256, 4 << 20
#: Bytes of words and their ids that a worker remembers, and of a word that is remembered.
CACHE, SHORT = 224 << 20, 64
#: Bytes of texts that are split into words at once (a longer text by itself).
SLICE = 8 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


#: A word that ends in ASCII marks other than apostrophes: the vocabulary splits before them.
MARKED = re.compile(rb"(?!.*<\|)(.*[A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)", re.S)


class _Words(dict):
    """Ids of words, with those of the last time it was half full behind it.

    Words with marks at their end are put together from their two parts each time; words over
    ``SHORT`` bytes are not remembered.
    """

    def __init__(self, encode):
        self.encode, self.old, self.room = encode, {}, CACHE // 2

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            marked = MARKED.fullmatch(word)
            if marked:
                return self[marked[1]] + self[marked[2]]
            out = self.encode(word)
        if len(word) <= SHORT:
            self.room -= 160 + len(word) + len(out)  # about what Python needs for both and their place
            if self.room < 0:
                self.old = dict(self)
                self.clear()
                self.room = CACHE // 2
            self[word] = out
        return out


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary is lower case and its own splitting never crosses ASCII white space, nor
    joins letters or digits with marks, so ids are remembered by word.
    """

    _known: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self._encode)

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _encode(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids(pa.array([text], pa.string())))

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null as empty; about ``SLICE`` bytes of texts at once.

        Words are split and numbered by Arrow, so that only a slice's distinct words are
        looked up one by one.
        """
        texts = pc.fill_null(texts, "")
        parts = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(texts)])) if len(texts) else [0]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            some = texts.slice(start, end - start)
            # Names of special tokens keep their case.
            some = pc.if_else(pc.match_substring(some, "<|"), some, pc.ascii_lower(some))
            split = pc.ascii_split_whitespace(some)
            words = split.flatten().dictionary_encode()
            known = list(map(self.words.__getitem__, words.dictionary.cast(pa.binary()).to_pylist()))
            found = pa.array(known, pa.large_binary()).take(words.indices)
            _, offsets, data = found.buffers()
            ends = np.frombuffer(offsets, np.int64, len(found) + 1)[split.offsets.to_numpy()]
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield data.slice(x, y - x).to_pybytes() if y > x else b""


class Packer:
    """Open documents, and the sequence in work."""

    def __init__(self, length: int, segments: int, loss: int, first_id: int):
        self.limit = np.array([length, segments, loss], np.float64)
        self.length, self.next_id, self.rows = length, first_id, []
        self.open: list[tuple] = []  # (doc_id, ids, start, prompt)
        self.sizes = np.zeros((0, 3))
        self._reset()

    def _reset(self):
        self.left, self.pieces = self.limit.copy(), []

    def add(self, doc_id, ids: bytes, prompt: int):
        self.open.append((doc_id, ids, 0, prompt))
        self.sizes = np.vstack((self.sizes, self._size(ids, 0, prompt)))

    @staticmethod
    def _size(ids, start, prompt):
        n = len(ids) // 4
        return np.array([n - start, 1, n - max(start, min(prompt, n))], np.float64)

    def tokens(self) -> float:
        return float(self.sizes[:, 0].sum())

    def fill(self, keep: int, tokens: float = np.inf):
        """Closes sequences until at most ``keep`` documents with ``tokens`` tokens left are open."""
        while len(self.open) > keep or self.open and self.tokens() > tokens:
            if len(self.rows) >= 4000:
                return
            fits = (self.sizes <= self.left).all(axis=1)
            if fits.any():
                worth = (self.sizes / self.limit) @ (self.left / self.limit)
                self._take(int(np.argmax(np.where(fits, worth, -1.0))), None)
            else:
                self._cut()
            if self.left[0] == 0 or self.left[1] == 0:
                self._close()

    def _cut(self):
        """Fills the room with a part of the longest document, as far as loss allows."""
        k = int(np.argmax(self.sizes[:, 0]))
        _, ids, start, prompt = self.open[k]
        free = max(0, min(prompt, len(ids) // 4) - start)  # tokens that bear no loss come first
        n = int(min(self.left[0], free + self.left[2], self.sizes[k, 0]))
        if n:
            self._take(k, n)
        if self.left[0] and (not n or self.left[2] == 0):
            self._close()

    def _take(self, k: int, n: int | None):
        doc_id, ids, start, prompt = self.open[k]
        total = len(ids) // 4
        n = total - start if n is None else n
        loss = max(0, start + n - max(start, prompt))
        self.pieces.append((doc_id, ids, start, n, prompt))
        self.left -= (n, 1, loss)
        if start + n < total:
            self.open[k] = (doc_id, ids, start + n, prompt)
            self.sizes[k] = self._size(ids, start + n, prompt)
        else:
            last = self.open.pop()
            if k < len(self.open):
                self.open[k], self.sizes[k] = last, self.sizes[-1]
            self.sizes = self.sizes[:-1]

    def _close(self):
        """Writes the sequence; a short one in powers of two, largest first."""
        total = sum(p[3] for p in self.pieces)
        parts = [total] if total == self.length else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        pieces, room, offset = list(reversed(self.pieces)), 0, 0
        parts = list(reversed(parts))
        while pieces:
            if not room:
                room, offset, sequence, self.next_id = parts.pop(), 0, self.next_id, self.next_id + 1
            doc_id, ids, start, n, prompt = pieces.pop()
            m = min(n, room)
            if m < n:
                pieces.append((doc_id, ids, start + m, n - m, prompt))
            loss = max(0, start + m - max(start, prompt))
            self.rows.append((doc_id, start, m, ids[4 * start : 4 * (start + m)], len(ids) // 4, loss, sequence, offset))
            room, offset = room - m, offset + m
        self._reset()



def _pack(path: str, length: int, segments: int, loss: int, end_id: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        tokenizer, end = WordTokenizer.at(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(length, segments, loss, TaskContext.get().partitionId() << 33)

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, ids, prompt in zip(batch.column(0).to_pylist(), tokenizer.all_ids(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                packer.add(doc_id, ids + end, prompt or 0)
                if len(packer.open) >= 2 * POOL or packer.tokens() > POOL_TOKENS:
                    packer.fill(POOL, POOL_TOKENS / 2)
                while len(packer.rows) >= 4000:
                    yield out()
                    packer.fill(2 * POOL, POOL_TOKENS)
        while packer.open:
            packer.fill(0)
            if packer.rows:
                yield out()
        if packer.pieces:
            packer._close()
        if packer.rows:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(prompt) if prompt else F.lit(0)).cast("long").alias("prompt"))
    return rows.mapInArrow(_pack(tokenizer_path, length, segments, length if loss is None else loss, end_id), PIECES)
