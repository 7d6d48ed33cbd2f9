"""Benchmark decontamination by a broadcast set of normalised word windows.

Every benchmark text gives its windows of ``WINDOW`` words (a shorter text: one window of
all its words).  A window's hash is a weighted sum of its words' hashes, so those of all of a
document's windows are sums of shifted arrays.  They are looked up in a bitmap, then among
the benchmark's sorted hashes; each hit is verified against the item's own words, and the
words inside any hit are marked.

Null texts and texts without words are never hit and, as benchmark items, hit nothing.
Items that repeat an item_id count once; a null item_id counts as an empty string.  Repeated
rows are scanned one by one; an empty table gives an empty one.  What is broadcast at once is
bounded by ``MAX_BYTES`` of benchmark text: a larger benchmark is dealt into parts by a hash
of its items (a longer item is a part by itself), each of which scans the documents and adds
to what the parts before it found.  Of a part each worker holds the words, 16 to 20 bytes a
distinct window and 4 an owner, as plain arrays: about five bytes a byte of text.  A
document's text is held whole, with a few numbers a word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import written

WINDOW = 10
#: Bytes of benchmark texts whose windows are sent to every executor at once.
MAX_BYTES = 12 << 20

FOUND = StructType([StructField("__n", LongType()), StructField("__k", LongType()), StructField("__hit", BinaryType()), StructField("__items", ArrayType(StringType()))])

#: Bytes that are no part of a word become blanks, A-Z become a-z.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def window_hashes(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The hash of every window of ``len(weights)`` words."""
    many = max(len(words) - len(weights) + 1, 0)
    out = np.zeros(many, np.uint64)
    for i, weight in enumerate(weights):
        out += words[i : i + many] * weight
    return out


class _Sorted:
    """The distinct windows of one size: hashes in order, where each stands in the words, and its owners."""

    def __init__(self, size: int, words: np.ndarray, blob: bytes, starts: np.ndarray, ranges: list[tuple[int, int, int]]):
        self.size = size
        at = np.concatenate([np.arange(low, high - size + 1, dtype=np.int64) for _, low, high in ranges])
        owner = np.repeat(np.array([item for item, _, _ in ranges], np.int32), [high - low - size + 1 for _, low, high in ranges])
        seed = size
        while not self._sort(words, blob, starts, at, owner, seed):
            seed += 1000  # two windows with one hash: other weights
        bits = 16
        while 1 << bits < 16 * len(self.hashes):
            bits += 1
        self.shift, self.bitmap = np.uint64(64 - bits), np.zeros(1 << bits - 3, np.uint8)
        low = self.hashes >> self.shift
        np.bitwise_or.at(self.bitmap, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def _sort(self, words, blob, starts, at, owner, seed) -> bool:
        self.weights = np.random.default_rng(seed).integers(1, 1 << 62, self.size).astype(np.uint64) | np.uint64(1)
        h = window_hashes(words, self.weights)[at]
        order = np.lexsort((owner, h))
        h, at, owner = h[order], at[order], owner[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        text = lambda i: blob[starts[i] : starts[i + self.size]]
        for i in np.flatnonzero(~new).tolist():
            if text(at[i]) != text(at[i - 1]):
                return False
        # An item may hold a window twice.
        keep = new | np.concatenate(([True], owner[1:] != owner[:-1]))
        self.hashes, self.start = h[first], starts[at[first]]
        self.owners = owner[keep]
        self.first_owner = np.concatenate((np.cumsum(keep)[first] - 1, [keep.sum()])).astype(np.int64)
        return True

    def seek(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows whose hash is known, and where it stands."""
        h = window_hashes(words, self.weights)
        low = h >> self.shift
        at = np.flatnonzero((self.bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        return at[same], k[same]


class Windows:
    """All windows of a part of the benchmark (item, text), by size."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items, ranges, parts, hashes, sizes = [], {}, [], [], []
        n = 0
        for item, text in items:
            ws = words(text)
            if ws:
                size = min(window, len(ws))
                ranges.setdefault(size, []).append((len(self.items), n, n + len(ws)))
                self.items.append(item)
                parts.append(b" ".join(ws))
                hashes.append(hashed(ws))
                sizes.append(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
                n += len(ws)
        self.blob = b" ".join([*parts, b""])
        starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if n else np.zeros(1, np.int64)
        every = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
        self.by_size = [_Sorted(size, every, self.blob, starts, own) for size, own in sorted(ranges.items())]

    def find(self, ws: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside a window that occurs, and whose windows occur."""
        hit, found = np.zeros(len(ws), bool), set()
        own = hashed(ws)
        for sorted_ in self.by_size:
            if len(ws) < sorted_.size:
                continue
            known = set()
            for i, k in zip(*(x.tolist() for x in sorted_.seek(own)), strict=True):
                text = b" ".join([*ws[i : i + sorted_.size], b""])
                start = int(sorted_.start[k])
                if self.blob[start : start + len(text)] == text:  # verified, word by word
                    hit[i : i + sorted_.size] = True
                    known.add(k)
            for k in known:
                found.update(self.items[o] for o in sorted_.owners[sorted_.first_owner[k] : sorted_.first_owner[k + 1]].tolist())
        return hit, found


def without(text: str, hit: np.ndarray) -> str:
    """The text without the runs of hit words and what stands between them."""
    out, at, places = [], 0, list(WORD.finditer(text))
    i = 0
    while i < len(places):
        if hit[i]:
            j = i
            while j + 1 < len(places) and hit[j + 1]:
                j += 1
            out.append(text[at : places[i].start()])
            at, i = places[j].end(), j
        i += 1
    return "".join([*out, text[at:]])


def _scan(sent, fresh: bool):
    """Adds to the hit words (a bit each) and items that earlier parts of the benchmark found."""

    def run(batches):
        windows = sent.value
        for batch in batches:
            rows, columns = [], batch.columns if fresh else batch.columns[:-4]
            before = [None] * len(batch) if fresh else zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)
            for text, known in zip(batch.column(0).to_pylist(), before, strict=True):
                ws = words(text)
                hit, found = windows.find(ws)
                if known:
                    hit |= bits(known[0], len(ws))
                    found.update(known[1])
                n = int(hit.sum())
                rows.append((len(ws), n, np.packbits(hit).tobytes() if n else b"", sorted(found)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*batch.schema.names[: len(columns)], *FOUND.names])

    return run


def bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


def _parts(benchmark: DataFrame, max_bytes: int) -> list[DataFrame]:
    """Items (item, text) in parts of about ``max_bytes``."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    count = -(-size // max_bytes)
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)] if count > 1 else [items]


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` (text first) with ``__n`` words, ``__k`` of them hit, ``__hit``, a bit a word (empty: none), and ``__items``."""
    schema = StructType([*docs.schema.fields, *FOUND.fields])
    parts, out = _parts(benchmark, max_bytes), docs
    for k, part in enumerate(parts):
        sent = docs.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in part.collect()], window))
        out = (written(out, "marked") if k else out).mapInArrow(_scan(sent, not k), schema)
    return out


def _clean(batches):
    for batch in batches:
        text, sizes, hits = (batch.column(i).to_pylist() for i in range(3))
        clean = [without(t, bits(h, n)) if h else t for t, n, h in zip(text, sizes, hits, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(clean, pa.string())], ["doc_id", "n_words", "n_hit", "items", "clean"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items and clean.

    ``items`` are the item_ids with occurring windows, sorted as strings; ``clean`` is the
    text with hit spans removed.
    """
    found = marked(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), benchmark, window, max_bytes)
    out = [F.col("doc_id"), F.col("__n").alias("n_words"), F.col("__k").alias("n_hit"), F.col("__items").alias("items")]
    if not with_text:
        return found.select(*out, F.lit(None).cast("string").alias("clean"))
    return found.select("text", "__n", "__hit", *out).mapInArrow(_clean, "doc_id long, n_words long, n_hit long, items array<string>, clean string")


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``docs`` without a hit, all columns; each row by its own verdict, without a join."""
    own = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"))
    kept = marked(own, benchmark, window, max_bytes).where("__k = 0")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns])
