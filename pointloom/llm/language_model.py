"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every token 1-gram and 2-gram (with ``order`` 3 also every 3-gram) of the
training documents, the events (n-gram, 1) ... (n-gram, q) where q is its count's level on a logarithmic scale.  A count is
read by asking for level after level until one is absent.  The filter's size follows the
corpus at ``BITS`` a level.  Up to ``max_bytes`` it is sent to all workers; a larger one stays
a table of blocks, and the documents' n-grams go to the block that holds them and come back
with their levels.  Scores are the same either way.

Smoothing is Dirichlet: P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu) with
P(w) = (c(w) + 1) / (N + V + 1), and with 3-grams P(w | uv) = (c(uvw) + mu3 P(w | v)) / (c(uv) + mu3);
all counts as the filter gives them, none over that of its context.  The first token's context
is the end token alone.  3-grams tell texts that occur elsewhere better apart, at more than twice
the filter and the shuffled n-grams.

Inside a block an n-gram is known by 32 bits of its hash: a block holds about a million, so
one of thousands shares its own with another, far fewer than the filter's own false answers.

A base score beside it needs exact 1-gram counts, kept by 96 bits of hashes of a token.  The
``HEAD`` most frequent tokens at most are sent to all workers, the rest are joined; so a
frequent word is never a join key.

One pass over the training texts counts both.  Texts are split and their words numbered by
Arrow, about ``SLICE`` bytes at once (a longer text by itself); only a slice's distinct words
are hashed.

Null or empty texts have the end token only.  Repeated rows are learnt and scored one by
one.  With no training document every count is zero.  An empty table to score gives an
empty one; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

END = b"\n"  # no word holds it
BASE = 1.5
BITS, HASHES = 6, 3
MU, MU3 = 2000.0, 10.0
ORDER = 2
HEAD = 300_000
#: Bytes of training text that share a block of the filter.
BLOCK_BYTES = 6 << 20
#: Largest filter that is sent to all workers: each holds a copy of its own.
MAX_BYTES = 64 << 20
#: Bytes of text handled at once, and n-grams a worker counts before it passes them on.
SLICE, HELD = 2 << 20, 2_000_000
#: Documents of a chunk whose n-grams are asked for together, as a power of two; a text over ``LONG`` bytes is one by itself.
CHUNK_BITS, LONG = 9, 1 << 16

#: The part of a hash that an n-gram is known by in its block, in bytes and as a mask.
WIDTH = 4
OWN = np.uint64((1 << 8 * WIDTH) - 1)

#: Bytes of words that are hashed at once.
PIECE = 1 << 20

#: Odd factors that make hashes differ (fixed values).
SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), vectorised."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(SALTS[0]) + w)


@functools.cache
def _factors(salt: int) -> np.ndarray:
    """Factors of the first places of a word; those of later ones are worked out each time."""
    return _factor(np.arange(4096), salt)


def _factor(place: np.ndarray, salt: int) -> np.ndarray:
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(salt))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each string, one of 64 and one of 32 bits: its bytes, each times a random factor of its place, summed.

    Bytes are summed a megabyte at a time, so a word of any length needs little room.
    """
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    sums, carry = np.zeros((2, n + 1), np.uint64), dict.fromkeys(SALTS, np.uint64(0))  # of all bytes before each end
    for at in range(0, len(data), PIECE):
        to = min(len(data), at + PIECE)
        first, last = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, to, "left")
        here = np.diff(np.clip(ends[first : last + 1], at, to))
        place = np.arange(at, to) - np.repeat(ends[first:last], here)
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(ends, to, "right")
        for total, salt in zip(sums, SALTS, strict=True):
            factor = _factors(salt)[place] if place.max() < 4096 else _factor(place, salt)
            part = np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * factor)
            part += carry[salt]
            total[low:high] = part[ends[low:high] - at - 1]
            carry[salt] = part[-1]
    size = np.diff(ends).astype(np.uint64)
    one, two = (mix(total[1:] - total[:-1] + size * np.uint64(salt)) for total, salt in zip(sums, SALTS, strict=True))
    return one, (two >> np.uint64(32)).astype(np.uint32)


END_HASHES = word_hashes(pa.array([END.decode()], pa.string()))


@dataclass
class Tokens:
    """Tokens of some texts, one text after the other: numbers of words, the last number the end token."""

    sizes: np.ndarray  # of the texts, end tokens included
    ids: np.ndarray
    h1: np.ndarray  # by number
    h2: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def before(self) -> np.ndarray:
        """Before each token.  What stands before a text is the end token, of the text before or not."""
        return np.concatenate((np.array([len(self.h1) - 1]), self.ids[:-1]))

    def grams(self, order: int) -> np.ndarray:
        """Hashes of the 2-grams that end in each token, then of the 3-grams, of all but a text's first token."""
        pairs = pair_hash(self.h1[self.before()], self.h1[self.ids])
        if order < 3:
            return pairs
        at = np.delete(np.arange(len(pairs)), self.starts)
        return np.concatenate((pairs, pair_hash(pairs[at - 1], self.h1[self.ids[at]])))


def tokenized(texts: pa.Array) -> Tokens:
    """Words with A-Z lower-cased, then the end token."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = split.flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
    h1, h2 = word_hashes(words)
    none = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0) if len(words) else []
    if len(none):  # before a blank at the start, after one at the end, and of empty texts
        own, keep = np.repeat(np.arange(len(sizes)), sizes), ids != none[0]
        sizes, ids = np.bincount(own[keep], minlength=len(sizes)), ids[keep]
    out, word = np.full(len(ids) + len(sizes), len(h1)), np.ones(len(ids) + len(sizes), bool)
    word[np.cumsum(sizes + 1) - 1] = False
    out[word] = ids
    return Tokens(sizes + 1, out, np.concatenate((h1, END_HASHES[0])), np.concatenate((h2, END_HASHES[1])))


def slices(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """Place of the first text and tokens of about ``SLICE`` bytes of texts at once."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(texts)]))
    for start, end in itertools.pairwise(cuts.tolist()):
        yield start, tokenized(texts.slice(start, end - start))
    trim()


def trim() -> None:
    """Hands freed memory back: the workers of an executor live through many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_at() -> np.ndarray:
    """Count that a level stands for: the middle of the whole numbers it covers."""
    out = [0.0]
    for q in range(1, 120):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


class Filter:
    """Blocks one after the other; an n-gram's bits all lie in its block.

    sizes: bits of each block.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes.astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def hashed(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix((h & OWN) + np.array([level], np.uint64) * np.uint64(SALTS[1]))
        return x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)

    @staticmethod
    def position(a: np.ndarray, b: np.ndarray, i: int, size) -> np.ndarray:
        return (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)

    @classmethod
    def positions(cls, h: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        a, b = cls.hashed(h, level)
        return (cls.position(a, b, i, np.uint64(size)) for i in range(HASHES))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level each n-gram holds, asking upwards from 1."""
        out = np.zeros(len(h), np.int64)
        if not len(self.sizes):
            return out
        block = block_of(h, len(self.sizes)).astype(np.int64)
        live, start, size, level = np.arange(len(h)), self.starts[block], self.sizes[block], 0
        while len(live):
            level += 1
            held = self._holds(h, start, size, level)
            live, h, start, size = live[held], h[held], start[held], size[held]
            out[live] = level
        return out

    def each(self, h: np.ndarray) -> np.ndarray:
        """``levels`` where many are equal: frequent n-grams stand on many levels, so each is read once."""
        kinds, place = np.unique(h, return_inverse=True)
        return self.levels(kinds)[place]

    def _holds(self, h: np.ndarray, start: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
        """Places of those n-grams all of whose bits are set, one hash after the other."""
        (a, b), keep = self.hashed(h, level), np.arange(len(h))
        for i in range(HASHES):
            at = start + self.position(a, b, i, size)
            on = np.flatnonzero((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            keep, a, b, start, size = keep[on], a[on], b[on], start[on], size[on]
        return keep


def bits_of(h: np.ndarray, q: np.ndarray, each: int = BITS) -> bytes:
    """A block that holds n-grams up to their levels, with ``each`` bits for each level."""
    size = 64 * math.ceil(int(q.sum()) * each / 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in Filter.positions(h[q >= level], level, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


# ---------------------------------------------------------------- counting


def _count(blocks: int, order: int):
    """Rows (block, grams, words): 2-grams by their hash, tokens by both of theirs, and how often each occurs."""

    def flush(grams, words):
        h, c = counted(np.concatenate(grams))
        h1, h2, n = summed(*map(np.concatenate, zip(*words, strict=True)))
        ends = np.arange(blocks + 1)
        x, y = np.searchsorted(block_of(h, blocks), ends), np.searchsorted(block_of(h1, blocks), ends)
        for at in range(0, blocks, 64):
            some = range(at, min(at + 64, blocks))
            first = [pack(h[x[k] : x[k + 1]], c[x[k] : x[k + 1]], WIDTH) for k in some]
            second = [h2[y[k] : y[k + 1]].tobytes() + pack(h1[y[k] : y[k + 1]], n[y[k] : y[k + 1]], 8) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["block", "grams", "words"])

    def run(batches):
        grams, words, n = [], [], 0
        for batch in batches:
            for _, t in slices(batch.column(0)):
                c = np.bincount(t.ids, minlength=len(t.h1))
                seen = c > 0  # a blank's empty neighbour has a number and is no word
                grams.append(t.grams(order))
                words.append((t.h1[seen], t.h2[seen], c[seen]))
                n += len(grams[-1]) + 2 * len(words[-1][0])
                if n > HELD:
                    yield from flush(grams, words)
                    grams, words, n = [], [], 0
        if grams:
            yield from flush(grams, words)
        del grams, words
        trim()

    return run


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and how often each occurs.  (numpy's ``unique`` puts them into a hash table first, which takes much longer.)"""
    h = np.sort(h)
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    return h[starts], np.diff(starts, append=len(h))


def summed(*cols: np.ndarray) -> list[np.ndarray]:
    """Rows with equal keys as one, counts (the last column) added; sorted by the first key."""
    order = np.argsort(cols[0])
    *keys, c = (x[order] for x in cols)
    if not len(c):
        return [*keys, c]
    new = [x[1:] != x[:-1] for x in keys]
    if any((x & ~new[0]).any() for x in new[1:]):  # the first key alone does not tell
        order = np.lexsort(cols[-2::-1])
        *keys, c = (x[order] for x in cols)
        new = [x[1:] != x[:-1] for x in keys]
    starts = np.flatnonzero(np.concatenate(([True], functools.reduce(np.logical_or, new))))
    return [*(x[starts] for x in keys), np.add.reduceat(c, starts)]


def pack(h: np.ndarray, c: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of hashes, one byte a count, the counts over 254, and how many those are."""
    small = np.minimum(c, 255).astype(np.uint8)
    large = c[small == 255].astype(np.int64)
    own = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8)[:, :width]
    return own.tobytes() + small.tobytes() + large.tobytes() + np.int64(len(large)).tobytes()


def unpack(data: bytes, width: int, before: int = 0) -> tuple[np.ndarray, ...]:
    """What ``pack`` made: hashes and counts; with ``before`` also numbers of that many bytes that stand before."""
    large = int(np.frombuffer(data, np.int64, 1, len(data) - 8)[0])
    n = (len(data) - 8 - 8 * large) // (before + width + 1)
    h = np.zeros((n, 8), np.uint8)
    h[:, :width] = np.frombuffer(data, np.uint8, n * width, n * before).reshape(n, width)
    c = np.frombuffer(data, np.uint8, n, n * (before + width)).astype(np.int64)
    c[c == 255] = np.frombuffer(data[len(data) - 8 - 8 * large : len(data) - 8], np.int64)
    out = h.view(np.uint64)[:, 0]
    return (out, np.frombuffer(data, np.uint32, n), c) if before else (out, c)


def _built(each: int):
    """One block: its bits, its tokens with their exact counts, how many those are and how many kinds."""

    def run(key, table):
        h, c = map(np.concatenate, zip(*(unpack(x, WIDTH) for x in table.column("grams").to_pylist()), strict=True))
        h1, h2, n = summed(*map(np.concatenate, zip(*(unpack(x, 8, 4) for x in table.column("words").to_pylist()), strict=True)))
        h, c = summed(np.concatenate((h, h1 & OWN)), np.concatenate((c, n)))
        row = [key[0].as_py(), bits_of(h, level_of(c), each), h2.tobytes() + pack(h1, n, 8), len(n), int(n.sum())]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "bits", "words", "kinds", "tokens"])

    return run


def _words(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            h1, h2, c = unpack(data, 8, 4)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(c)], ["h1", "h2", "c"])


@dataclass
class Learnt:
    """What the training texts gave: exact token counts, and the filter as a table of its blocks."""

    vocabulary: DataFrame  # h1, h2, c
    tokens: int
    kinds: int
    bits: DataFrame  # block, bits
    blocks: int
    size: int  # bytes of all blocks

    def filter(self) -> Filter:
        """The whole filter; its bytes reach the driver."""
        found = [np.zeros(0, np.uint8)] * self.blocks
        for row in self.bits.toLocalIterator():
            found[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        return Filter(np.concatenate([*found, np.zeros(0, np.uint8)]), np.array([8 * len(x) for x in found]))


def learn(texts: DataFrame, order: int = ORDER, each: int = BITS) -> Learnt:
    """Counts n-grams block by block and builds each block's bits in one task."""
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = texts.select("text").mapInArrow(_count(blocks, order), "block long, grams binary, words binary").groupBy("block")
    table = written(found.applyInArrow(_built(each), "block long, bits binary, words binary, kinds long, tokens long"), "blocks")
    vocabulary = table.select("words").mapInArrow(_words, "h1 long, h2 int, c long")
    totals = table.agg(F.sum("tokens"), F.sum("kinds"), F.sum(F.octet_length("bits")), F.count("*")).collect()[0]
    tokens, kinds, bits, full = (int(x or 0) for x in totals)
    return Learnt(vocabulary, tokens, kinds, table.select("block", "bits"), blocks if full else 0, bits)


# ---------------------------------------------------------------- asking block by block


def asked(tokens: list[Tokens], order: int) -> np.ndarray:
    """Sorted hashes of all n-grams of some texts."""
    return counted(np.concatenate([x for t in tokens for x in (t.grams(order), t.h1)]))[0]


def pieces(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Bytes of the numbers between each cut and the next."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _probes(blocks: int, order: int):
    """Input chunk, n, text; rows (chunk, part, block, data): the n-grams of neighbours of one chunk.

    A part is named by the number n of its first text.
    """

    def run(batches):
        for batch in batches:
            chunk, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)])) if len(chunk) else [0]
            for start, end in itertools.pairwise(edges):
                h = asked([t for _, t in slices(batch.column(2).slice(start, end - start))], order)
                block = block_of(h, blocks)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(h)]))
                full, data = block[cuts[:-1]].astype(np.int64), pieces(h.astype(np.uint32), cuts)
                named = [pa.array(np.full(len(full), x[start])) for x in (chunk, first)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(full), data], ["chunk", "part", "block", "data"])

    return run


def _answers(key, probes, bits):
    """The probes of one block and its bits: rows (chunk, part, block, data), a byte a level.

    Chunks ask for the same n-grams; each is read once.
    """
    data, found = bits.column("bits").to_pylist(), probes.column("data").to_pylist()
    own = Filter(np.frombuffer(data[0], np.uint8), np.array([8 * len(data[0])])) if data else Filter(np.zeros(0, np.uint8), np.zeros(0))
    cuts, h = np.cumsum([0, *map(len, found)]) // WIDTH, np.frombuffer(b"".join(found), np.uint32)
    kinds = counted(h)[0]
    levels = own.levels(kinds.astype(np.uint64)).astype(np.uint8)[np.searchsorted(kinds, h)]
    return pa.table([*(probes.column(c) for c in ("chunk", "part", "block")), pieces(levels, cuts)], names=["chunk", "part", "block", "data"])


def told(tokens: list[Tokens], order: int, answers: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Levels of the words and of the n-grams of each of some ``tokens``, from the answers to what is ``asked``."""
    parts = [x for t in tokens for x in (t.h1, t.grams(order))]
    kinds, place = np.unique(np.concatenate(parts), return_inverse=True)
    levels = np.concatenate([np.frombuffer(x, np.uint8) for x in answers])
    if len(levels) != len(kinds):
        raise RuntimeError("a part's n-grams and their answers differ")
    found = np.split(levels[place], np.cumsum([len(x) for x in parts])[:-1])
    return zip(found[::2], found[1::2], strict=True)


# ---------------------------------------------------------------- scoring


def _score_chunk(order: int, *model):
    """The documents of one chunk and the answers to their probes, part by part."""

    def run(key, docs, answers):
        docs, answers = docs.sort_by("n"), answers.sort_by([("part", "ascending"), ("block", "ascending")])
        part, data = answers.column("part").to_numpy(), answers.column("data").to_pylist()
        firsts = np.unique(part)
        ends = [*np.searchsorted(docs.column("n").to_numpy(), firsts[1:]).tolist(), len(docs)]
        out, start = [], 0
        for first, end in zip(firsts, ends, strict=True):
            (batch,) = docs.select(["doc_id", "text"]).slice(start, end - start).combine_chunks().to_batches()
            named, tokens = zip(*_split([batch]), strict=True)
            levels = told(tokens, order, data[np.searchsorted(part, first) : np.searchsorted(part, first, "right")])
            out += _scored(((n, t, *q) for n, t, q in zip(named, tokens, levels, strict=True)), order, *model)
            start = end
        return pa.Table.from_batches(out)

    return run


def _score(bloom, order: int, *model):
    def run(batches):
        own = Filter(*bloom.value)
        return _scored(((named, t, own.levels(t.h1), own.each(t.grams(order))) for named, t in _split(batches)), order, *model)

    return run


def _split(batches) -> Iterator[tuple[pa.Array, Tokens]]:
    """Ids and tokens of a slice of texts at once."""
    for batch in batches:
        for at, t in slices(batch.column(1)):
            yield batch.column(0).slice(at, len(t.sizes)), t


def _scored(texts, order: int, sent, n_train: int, v_train: int, mu: float, mu3: float):
    """texts: ids, tokens, levels of words and of n-grams; sent: two hashes of the most frequent tokens, sorted by the first, and log10(c + 1)."""
    head = sent.value
    scale, counts = math.log10(n_train + v_train + 1), count_at()
    for named, t, of_words, of_grams in texts:
        seen, read = counts[of_words], counts[of_grams]  # counts by the filter, of words by number
        before, ids, starts = t.before(), t.ids, t.starts
        pair = np.minimum(read[: len(ids)], seen[before])
        p = (pair + (mu * (seen + 1) / (n_train + v_train + 1))[ids]) / (seen + mu)[before]
        if order > 2:
            context, triple = np.concatenate((np.zeros(1), pair[:-1])), np.zeros(len(ids))
            context[starts] = 0.0
            triple[np.delete(np.arange(len(ids)), starts)] = read[len(ids) :]
            p = (np.minimum(triple, context) + mu3 * p) / (context + mu3)
        scores = np.add.reduceat(np.log10(p), starts)
        logs = _frequent(t, head)
        own = logs[ids]
        found = np.add.reduceat((own > 0).astype(np.int64), starts)
        base = np.add.reduceat(own, starts) - scale * t.sizes
        # The other tokens of each document, with their number in it.
        rare = np.flatnonzero(own == 0)
        kinds, docs = len(t.h1), len(starts)
        rest, times = np.unique((np.searchsorted(starts, rare, "right") - 1) * kinds + ids[rare], return_counts=True)
        doc, rest = np.divmod(rest, kinds)
        cuts = np.searchsorted(doc, np.arange(docs + 1))
        pairs = pa.StructArray.from_arrays([pa.array(t.h1[rest].view(np.int64)), pa.array(t.h2[rest].view(np.int32)), pa.array(times, pa.int64())], ["h1", "h2", "n"])
        yield pa.RecordBatch.from_arrays(
            [named, pa.array(t.sizes, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)],
            ["doc_id", "n_tokens", "found", "base", "score", "rest"],
        )


def _frequent(t: Tokens, head) -> np.ndarray:
    """By number: log10(c + 1) of frequent tokens, 0 of others."""
    h1, h2, logs = head
    if not len(h1):
        return np.zeros(len(t.h1))
    order, at = np.argsort(t.h1), np.empty(len(t.h1), np.int64)
    at[order] = np.minimum(np.searchsorted(h1, t.h1[order]), len(h1) - 1)
    return np.where((h1[at] == t.h1) & (h2[at] == t.h2), logs[at], 0.0)


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, mu: float = MU, mu3: float = MU3, max_bytes: int = MAX_BYTES, head_size: int = HEAD, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` has the texts to learn from.  With more ``bits`` a level the filter errs less.
    """
    spark = docs.sparkSession
    model = learn(train, order, bits)
    vocabulary, n_train, v_train = model.vocabulary, model.tokens, model.kinds
    # The most frequent tokens, whole eighths of a power of two at a time, head_size at most.
    eighth = F.floor(F.log2("c") * 8).cast("int")
    cut, taken = None, 0
    for row in sorted(vocabulary.groupBy(eighth.alias("e")).count().collect(), key=lambda r: -r["e"]):
        if taken + row["count"] > head_size:
            break
        cut, taken = row["e"], taken + row["count"]
    rows = vocabulary.where(eighth >= F.lit(cut if cut is not None else 1 << 20)).toArrow()
    h1, h2, c = (rows.column(i).to_numpy() for i in range(3))
    sort = np.argsort(h1.view(np.uint64))
    sent_head = spark.sparkContext.broadcast((h1.view(np.uint64)[sort], h2.view(np.uint32)[sort], np.log10(c[sort] + 1)))
    schema = "doc_id long, n_tokens long, found long, base double, score double, rest array<struct<h1:bigint,h2:int,n:bigint>>"
    if model.size <= max_bytes:
        bloom = model.filter()
        sent = spark.sparkContext.broadcast((bloom.data, bloom.sizes))
        scored = docs.select("doc_id", "text").mapInArrow(_score(sent, order, sent_head, n_train, v_train, mu, mu3), schema)
    else:
        # Chunks of neighbours share n-grams, each asked for once.
        numbered = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text")
        chunk = F.when(F.octet_length("text") > LONG, -1 - F.col("n")).otherwise(F.shiftright("n", CHUNK_BITS))
        rows = written(numbered.select(chunk.alias("chunk"), "n", "doc_id", "text"), "rows")
        parts = "chunk long, part long, block long, data binary"
        probes = rows.select("chunk", "n", "text").mapInArrow(_probes(model.blocks, order), parts)
        answers = probes.groupBy("block").cogroup(model.bits.groupBy("block")).applyInArrow(_answers, parts)
        scored = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(order, sent_head, n_train, v_train, mu, mu3), schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h1", "x.h2", "x.n")
    known = rest.join(vocabulary, ["h1", "h2"]).groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("sum"))
    out = scored.drop("rest").join(known, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("sum", F.lit(0.0))).alias("base_score"), "score"
    )
