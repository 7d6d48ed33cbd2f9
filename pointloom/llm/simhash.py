"""SimHash near-dedup by tiled exact comparison.

Fingerprints of equal documents are merged first.  Two fingerprints that differ in at most
``radius`` bits agree in all but ``radius`` of ``radius + m`` bands, so each choice of ``m`` bands
is a candidate key; ``m`` grows with the number of fingerprints, so that few share a key by
chance.  Inside a key's value fingerprints stand sorted by their number of set bits, in tiles of
``TILE``.
A pair of tiles is compared by numpy exclusive-or and bit counts unless their bit counts are
further apart than the radius.  A band value with more than ``ITEM`` fingerprints is dealt
into slices whose pairs are work items of their own.  Every work item keeps only a spanning
forest of the links it finds, so a group of k near copies gives at most k - 1 rows an item;
links are taken by a hash of their ends, the same in all items, so that the forests of one
group are much alike and have no hubs.  Components come from alternating large-star and small-star rounds
on those links.

With a ``similarity``, candidates come from MinHash instead, as fingerprints of radius 3 are
too sparse for it: nodes are sets of shingles, and those that agree in one of ``bands_for``
bands of ``ROWS`` smallest hashes are candidates.  A pair of just that similarity is missed
with a chance of ``MISSED`` at most, wherever the texts differ.  Components of candidates are
only groups: inside each, all pairs are checked by the Jaccard similarity of their texts' word shingles, unless chains
of pairs that passed already join them.  So no two documents meet but by a chain of texts
that are that similar, and no such chain inside a group is missed.

Null texts have no words; texts without words get fingerprint 0 and link like others.  Rows
that repeat a doc_id are fingerprinted one by one.  A null doc_id never names a component
that has another id.  An empty table gives an empty one; columns other than doc_id and text are
not read, whatever their names.  Texts of any length are fingerprinted whole.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written

SHINGLE, SEED, RADIUS = 3, 42, 3
TILE, ITEM = 512, 32_768
#: Fingerprints that may share a key's value by chance before keys get another band.
CHANCE = 256
#: Shingles in a slice of a group whose pairs are checked.
PART = 1_000_000
#: Smallest hashes in a band, and the chance that a pair of the least similarity is no candidate.
ROWS, MISSED = 8, 1e-4


#: Makes further words of a signature from the shingles' hashes (a fixed value).
STEP = 0x9E3779B97F4A7C15


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in each column of ``h``: (n, words) -> (words, 64).

    Rows are added in halves as bit-sliced numbers, 64 at once; the last few by unpacking.
    """
    planes, total = [h], np.zeros((h.shape[1], 64), np.int64)

    def count(rows, weight):
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1, 8), axis=2, bitorder="little")
        total[:] += weight * bits.sum(axis=0, dtype=np.int64)

    while len(planes[0]) > 32:
        half = len(planes[0]) // 2
        if len(planes[0]) % 2:
            for j, p in enumerate(planes):
                count(p[-1:], 1 << j)
        out, carry = [], None
        for p in planes:
            x, y = p[:half], p[half : 2 * half]
            t, both = x ^ y, x & y
            out.append(t if carry is None else t ^ carry)
            carry = both if carry is None else both | (t & carry)
        planes = [*out, carry]
    for j, p in enumerate(planes):
        if len(p):
            count(p, 1 << j)
    return total


def signature(text: str | None, words_in: int = SHINGLE, size: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints; a bit is set if it is set in over half of the shingles' hashes.

    The first is over the hashes themselves, others over hashes of those.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(size, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_in, len(words))
    total, hash64 = np.zeros((size, 64), np.int64), xxhash.xxh64_intdigest
    n = len(words) - k + 1
    salts = np.arange(size, dtype=np.uint64) * np.uint64(STEP)
    for at in range(0, n, 1 << 14):  # a long text's bits are summed in slices
        to = min(n, at + (1 << 14))
        h = np.array([hash64(body[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)], np.uint64)[:, None]
        if size > 1:
            more = h ^ salts[1:]
            for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
                more = (more ^ (more >> np.uint64(shift))) * np.uint64(factor)
            h = np.concatenate((h, more ^ (more >> np.uint64(33))), axis=1)
        total += bit_counts(h)
    return np.packbits(2 * total > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, words_in: int = SHINGLE) -> int:
    return int(signature(text, words_in)[0])


def shingles(text: str | None, words_in: int) -> np.ndarray:
    """Distinct hashes of the text's word shingles (fewer words: the whole sequence; none: none)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k, hash64 = min(words_in, len(words)), xxhash.xxh64_intdigest
    found = {hash64(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)} if words else ()
    return np.fromiter(found, np.uint64, len(found)).view(np.int64)


def bands_for(least: float) -> int:
    """Bands with which a pair of similarity ``least`` is missed with a chance of ``MISSED``."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(least**ROWS)))) if least < 1 else 1


@functools.cache
def _hashing(places: int) -> np.ndarray:
    salts, factors = np.random.default_rng(SEED).integers(0, 1 << 32, (2, places), np.uint32)
    return np.stack((salts, factors | np.uint32(1)))


def band_keys(found: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band's ``ROWS`` smallest hashes of a set; other hash functions for each place."""
    salts, factors = _hashing(bands * ROWS)
    h, low = (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.full(bands * ROWS, ~np.uint32(0))
    for at in range(0, len(h), 64):
        np.minimum(low, ((h[at : at + 64, None] ^ salts) * factors).min(axis=0), out=low)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(STEP)
    for x in low.astype(np.uint64).reshape(bands, ROWS).T:
        key = (key ^ x) * np.uint64(0x7FB5D329728EA185)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _sketched(words_in: int, bands: int, prints: int):
    """prints: words of a fingerprint, or 0 for nulls."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [np.sort(shingles(t, words_in)) for t in texts]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            keys = np.concatenate([band_keys(x, bands) for x in sets]) if sets else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys))
            fps = pa.array([signature(t, prints).view(np.int64)[0] if prints else None for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, keys, batch.column(2), pa.array(nodes)], ["doc_id", "fp", "keys", "text_hash", "node"])

    return run


def candidates(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes with a common key. prints: node and own, its keys."""
    keyed = prints.select("node", F.explode("own").alias("key"))
    low = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return keyed.join(low.hint("merge"), "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _shingled(words_in: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(t, words_in) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["node", "again", "set"])

    return run


def _fingerprints(words_in: int, size: int):
    def run(batches):
        for batch in batches:
            prints = [signature(t, words_in, size).view(np.int64) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * size, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat[::size], pa.int64()), more, batch.column(2)], ["doc_id", "fp", "words", "text_hash"])

    return run


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links, as places in them, and each node's component (its smallest node).

    Links are taken in their order: every component takes its first link to another one.
    """
    label, live, kept = np.arange(nodes), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.concatenate(kept), label
        first = np.full(nodes, len(a))
        np.minimum.at(first, label[a[live]], live)
        np.minimum.at(first, label[b[live]], live)
        taken = np.unique(first[first < len(a)])
        kept.append(taken)
        x, y = a[taken], b[taken]
        while True:
            low = np.minimum(label[x], label[y])
            if (label[x] == label[y]).all():
                break
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            while not (new[new] == new).all():
                new = new[new]
            label = new[label]


def order_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order in which links of nodes are taken: by a hash of both ends."""
    low, high = np.minimum(a, b).view(np.uint64), np.maximum(a, b).view(np.uint64)
    h = (low * np.uint64(STEP)) ^ (high + (high >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return np.argsort(h ^ (h >> np.uint64(27)), kind="stable")


def links_in(prints: np.ndarray, radius: int, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``prints`` whose pairs are a spanning forest of the links among them, and their differing bits."""
    bits = np.bitwise_count(prints)
    order = np.lexsort((prints, bits))
    prints, bits = prints[order], bits[order].astype(np.int64)
    n, label = len(prints), np.arange(len(prints))
    node = prints.view(np.int64) if node is None else node[order]
    held, size = [np.zeros((3, 0), np.int64)], 0

    def reduced():
        nonlocal held, size, label
        a, b, d = np.concatenate(held, axis=1)
        first = order_of(node[a], node[b])
        a, b, d = a[first], b[first], d[first]
        kept, label = forest(n, a, b)
        held, size = [np.stack((a[kept], b[kept], d[kept]))], 0

    for i in range(0, n, TILE):
        i_end = min(n, i + TILE)
        for j in range(i, n, TILE):
            if bits[j] - bits[i_end - 1] > radius:
                break  # later tiles have still more bits
            j_end = min(n, j + TILE)
            apart = np.bitwise_count(prints[i:i_end, None] ^ prints[None, j:j_end])
            near = apart <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            x, y, d = x + i, y + j, apart[x, y].astype(np.int64)
            new = label[x] != label[y]
            if new.any():
                held.append(np.stack((x[new], y[new], d[new])))
                size += int(new.sum())
            if size > 1 << 20:
                reduced()
    reduced()
    a, b, d = held[0]
    return order[a], order[b], d


def _compare(radius: int):
    """Input sorted by work item: item, fp, node (long); items may span batches."""

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            item = cols[0]
            last = np.searchsorted(item, item[-1])
            yield from done([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from done(held)

    def done(cols):
        item, fp, node = cols[0], cols[1].astype(np.int64).view(np.uint64), cols[2]
        if len(item) < 2:
            return
        edges = np.flatnonzero(np.diff(item)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(item)]))
        size = ends - starts
        out_a, out_b, out_d = [node[:0]], [node[:0]], [node[:0]]
        held = [np.zeros((3, 0), np.int64)]
        # Many tiny items, each a tile: neighbours at each distance at once, unless their bit counts are too far apart.
        small, bits = np.repeat(size, size) <= 32, np.bitwise_count(fp).astype(np.int64)
        for d in range(1, int(size[size <= 32].max(initial=1))):
            x = np.flatnonzero((item[d:] == item[:-d]) & small[d:] & (np.abs(bits[d:] - bits[:-d]) <= radius))
            apart = np.bitwise_count(fp[x] ^ fp[x + d]).astype(np.int64)
            x, apart = x[apart <= radius], apart[apart <= radius]
            held.append(np.stack((x, x + d, apart)))
        x, y, apart = np.concatenate(held, axis=1)
        first = order_of(node[x], node[y])
        x, y, apart = x[first], y[first], apart[first]
        kept, _ = forest(len(item), x, y)  # of all these items at once
        out_a.append(node[x[kept]])
        out_b.append(node[y[kept]])
        out_d.append(apart[kept])
        for k in np.flatnonzero(size > 32):
            a, b, apart = links_in(fp[starts[k] : ends[k]], radius, node[starts[k] : ends[k]])
            out_a.append(node[starts[k] + a])
            out_b.append(node[starts[k] + b])
            out_d.append(apart)
        a, b, d = map(np.concatenate, (out_a, out_b, out_d))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "bits"])

    return run


def bands_in_key(count: int, radius: int) -> int:
    """How many bands make a key, so that at most about ``CHANCE`` of ``count`` fingerprints share one by chance."""
    m = 1
    while m < 4 and count >> (64 * m // (radius + m)) > CHANCE:
        m += 1
    return m


def links(prints: DataFrame, radius: int = RADIUS, m: int | None = None) -> DataFrame:
    """Rows (a, b, bits) that connect all nodes with fingerprints within ``radius`` bits.

    prints: node and fp (long), and, if nodes have several fingerprints, word, which one:
    only equal words are compared.  Any ``m`` gives the same components.
    """
    m = bands_in_key(prints.count(), radius) if m is None else m
    edges = [64 * i // (radius + m) for i in range(radius + m + 1)]
    band = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in itertools.pairwise(edges)]
    word = F.col("word") if "word" in prints.columns else F.lit(0)
    # A hash of the chosen bands: two values with one hash only mean more to compare.
    choices = [F.struct(word.alias("w"), F.xxhash64(F.lit(i), *own).alias("b")) for i, own in enumerate(itertools.combinations(band, m))]
    keyed = prints.select("node", "fp", F.explode(F.array(*choices)).alias("key"))
    # Few values are over the size of a work item: each takes that many fingerprints.
    large = written(keyed.groupBy("key").count().where(F.col("count") > ITEM).select("key", F.ceil(F.col("count") / ITEM).alias("slices")), "large")
    keyed = join_checked(keyed, large, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "node"), F.col("slices"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    items = keyed.select("fp", "node", "key", F.explode(pairs).alias("p")).select(F.xxhash64("key", "p.i", "p.j").alias("item"), "fp", "node")
    count = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return items.repartition(int(count), "item").sortWithinPartitions("item").mapInArrow(_compare(radius), "a long, b long, bits long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node it reaches.

    Large-star links a node's larger neighbours to its smallest one, small-star the smaller
    ones; both need no more than a minimum by node and a join with it, so that a hub's links
    stay spread.  Rounds end when every link is to a root.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        star = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = star.groupBy("x").agg(F.min("y").alias("m"))
        star = star.join(least, "x")
        new = star.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(star.select("x", F.col("m").alias("y"))).distinct()
        new = written(new, "edges")
        # A star forest: no node has two links up, and no root has one.
        tops = new.select(F.col("y").alias("x")).distinct()
        if new.groupBy("x").count().where("count > 1").isEmpty() and new.join(tops, "x", "left_semi").isEmpty():
            return new.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(tops.select(F.col("x").alias("node"), F.col("x").alias("root")))
        edges = new


def alike(flat: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs of sets with a Jaccard similarity of ``least`` or more.

    flat: the sets' elements one after the other; size: how many each has.  Every set that a
    component reaches is compared with all that are in none yet: no other pair can matter.
    A set is compared only if one of those holds one of its rarest elements, of which it
    can miss all but one too few to be that similar.
    """
    n, starts = len(size), np.concatenate(([0], np.cumsum(size)))
    owner, ids = np.repeat(np.arange(n), size), np.unique(flat, return_inverse=True)[1]
    kinds, free, left = int(ids.max(initial=-1)) + 1, np.ones(n, bool), n

    def index():
        live = free[owner]
        first = np.concatenate(([0], np.cumsum(np.bincount(ids[live], minlength=kinds))))
        return owner[live][np.argsort(ids[live], kind="stable")], first, left

    def holding(own):
        low, many = first[own], first[own + 1] - first[own]
        return holders[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]

    holders, first, indexed = index()
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], left, todo = False, left - 1, [seed]
        while todo and left:
            if 2 * left < indexed:
                holders, first, indexed = index()
            i = todo.pop()
            own = ids[starts[i] : starts[i + 1]]
            rare = own[np.argsort(first[own + 1] - first[own])][: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
            if not free[holding(rare)].any():
                continue
            both = np.bincount(holding(own), minlength=n)
            near = np.flatnonzero(free & (both >= least * (size[i] + size - both)))
            free[near], left = False, left - len(near)
            todo += near.tolist()
            out_a.append(np.full(len(near), i))
            out_b.append(near)
    return np.concatenate(out_a), np.concatenate(out_b)


def _alike(least: float):
    """Input sorted by work item: item, node (long), set; items may span batches."""

    def run(batches):
        held = None
        for batch in batches:
            sets = batch.column(2)
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            cut = int(cols[2][:last].sum())
            yield from done([*(c[:last] for c in cols[:3]), cols[3][:cut]])
            held = [*(c[last:] for c in cols[:3]), cols[3][cut:]]
        if held is not None:
            yield from done(held)

    def done(cols):
        item, node, size, flat = cols
        if len(item) < 2:
            return
        edges = np.flatnonzero(np.diff(item)) + 1
        at, out_a, out_b = np.concatenate(([0], np.cumsum(size))), [node[:0]], [node[:0]]
        for start, end in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(item)])), strict=True):
            if end - start > 1:
                a, b = alike(flat[at[start] : at[end]], size[start:end], least)
                out_a.append(node[start + a])
                out_b.append(node[start + b])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def similar(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all nodes of a group whose sets have a Jaccard similarity of ``least`` or more.

    groups: node and root; sets: node and set.  All pairs of a group count, checked before
    any is left out.  Groups with over ``PART`` elements are dealt into slices whose pairs
    are work items of their own.
    """
    held = sets.join(groups.hint("merge"), "node").select("root", "node", "set")
    large = held.groupBy("root").agg(F.sum(F.size("set")).alias("total")).where(F.col("total") > PART)
    large = written(large.select("root", F.ceil(F.col("total") / PART).alias("slices")), "large")
    held = join_checked(held, large, "root", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    items = held.select("root", "node", "set", F.explode(pairs).alias("p")).select(F.xxhash64("root", "p.i", "p.j").alias("item"), "node", "set")
    count = sets.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return items.repartition(int(count), "item").sortWithinPartitions("item").mapInArrow(_alike(least), "a long, b long")


def node_sets(docs: DataFrame, nodes: DataFrame, words_in: int) -> DataFrame:
    """node and set (shingle hashes) of a text of each node.

    docs: doc_id, text; nodes: node, of one of its texts doc_id and text_hash, and whether
    several rows have these.  Texts stay where they are; only such rows' sets are shuffled.
    """
    own = written(nodes.select(F.col("doc_id").alias("__id"), "text_hash", "node", "again"), "nodes")
    texts = docs.select("doc_id", "text")
    same = texts["doc_id"].eqNullSafe(own["__id"]) & (F.xxhash64(F.coalesce(texts["text"], F.lit(""))) == own["text_hash"])
    sets = join_checked(texts, own, same, "inner").select("node", "again", "text").mapInArrow(_shingled(words_in), "node long, again boolean, set array<long>")
    sets = written(sets, "sets")
    return sets.where("NOT again").unionByName(sets.where("again").dropDuplicates(["node"])).select("node", "set")


def _grouped(docs: DataFrame, words_in: int, radius: int, words: int, similarity: float | None, checked_words: int, by_prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_hash, node), and of each node component_id and first, the first row of its component."""
    rows = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    if similarity is None:
        rows = rows.mapInArrow(_fingerprints(words_in, words), "doc_id long, fp long, words array<long>, text_hash long")
        rows = rows.select("doc_id", "fp", "text_hash", *([F.xxhash64("words").alias("node"), "words"] if words > 1 else [F.col("fp").alias("node")]))
    else:
        sketched = _sketched(checked_words, bands_for(similarity), words_in)
        rows = rows.mapInArrow(sketched, "doc_id long, fp long, keys array<long>, text_hash long, node long")
    rows = written(rows, "prints")
    own = "keys" if similarity is not None else "words" if words > 1 else "fp"
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    prints = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(first).alias("first"), F.first(own).alias("own")), "distinct")
    if similarity is None:
        edges = links(prints.select("node", F.posexplode("own").alias("word", "fp")) if words > 1 else prints.select("node", F.col("own").alias("fp")), radius)
    else:
        groups = written(components(candidates(prints)), "groups")
        # Of a node's rows those that are its first; several only where rows repeat an id and text.
        times = rows.select("node", first.alias("row")).groupBy("node", "row").count().where("count > 1").select("node", "row").withColumn("again", F.lit(True))
        chosen = prints.select("node", F.col("first").alias("row")).join(groups, "node").join(times, ["node", "row"], "left")
        sets = node_sets(docs, chosen.select("node", "row.doc_id", "row.text_hash", F.coalesce("again", F.lit(False)).alias("again")), checked_words)
        edges = similar(groups, sets, similarity)
        if by_prints:
            edges = edges.unionByName(links(written(rows.select("node", "fp").distinct(), "node-prints"), radius).select("a", "b"))
    roots = written(components(edges).withColumnRenamed("node", "__node"), "roots")
    linked = prints.join(roots, F.col("node") == F.col("__node"))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("best"))
    linked = written(linked.join(best, "root").select("node", "component_id", "best"), "linked")
    # Nodes that link to no other: their own smallest id.
    known = prints.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("best", "first").alias("first"))
    return rows, known


def near_components(
    docs: DataFrame,
    words_in: int = SHINGLE,
    radius: int = RADIUS,
    words: int = 1,
    similarity: float | None = None,
    checked_words: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed 64-bit) and component_id.

    With more ``words``, documents have that many independent fingerprints and link if any
    two of the same word are within ``radius``: near copies whose single fingerprints are
    further apart are still found, at a work that grows with the number of words.

    With a ``similarity``, texts link if their shingles of ``checked_words`` words have that
    Jaccard similarity, whatever their fingerprints are.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, known = _grouped(docs, words_in, radius, words, similarity, checked_words)
    return rows.select("doc_id", "fp", "node").join(known.select("node", "component_id"), "node", "left").select("doc_id", "fp", "component_id")


def near_rows(docs: DataFrame, similarity: float, checked_words: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash and whether it is the first of its near copies.

    Near copies are texts whose fingerprints differ in at most ``RADIUS`` bits, and texts whose shingles
    have that similarity; both kinds of links count together.

    Rows stand in order of doc_id (nulls last), then text_hash; rows with equal ids and texts are alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, known = _grouped(docs, SHINGLE, RADIUS, 1, similarity, checked_words, by_prints=True)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return rows.join(known.select("node", "first"), "node").select("doc_id", "text_hash", own.eqNullSafe(F.col("first")).alias("first"))
