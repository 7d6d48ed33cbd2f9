"""Neighbourhoods by blocks: Spark deals out blocks of near points, numpy compares a block with what may be near it.

Points of a model are put into blocks of like size along a Z-curve (a range partitioning).
A work item is a block and the points of the blocks whose boxes may be near enough, in parts
of at most ``HELD`` points.  In it, runs of ``RUN`` points are met with leaves of ``LEAF``
points by their boxes: a leaf that is wholly inside a radius counts by its sums, one that is
outside not at all, and only others are looked at point by point.  So nothing is made a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import stored

#: Points of a block (fewer, down to the least, while there are few blocks), blocks wanted, points met at a time by a block.
BLOCK, LEAST_BLOCK, WANTED, HELD = 4096, 256, 96, 1 << 18
#: Points that are compared together, and points of a leaf they are compared with.
RUN, LEAF = 64, 16
#: Leaves that are looked at in one step, so that its arrays stay small, and points that are summed up around together.
TOGETHER, SUMMED = 64, 64
#: Bits an axis of the Z-curve.
BITS = 12
#: Rows of boxes that are broadcast.
FEW = 100_000
OWN, OTHER = 0, 1
PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def whole(points: DataFrame) -> DataFrame:
    """Points with a whole and finite place; others are near nothing."""
    for c in "xyz":
        points = points.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return points


class Blocks:
    """placed: points (model_id, point_id, x, y, z, more columns) and their block; boxes: n and bounds of each block; spans: of each model."""

    def __init__(self, points: DataFrame, more: tuple[str, ...] = (), size: int | None = None, apart: str | None = None):
        """``apart``: a column whose values come in blocks of their own, as far as blocks allow."""
        points = whole(points.select("model_id", "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], *more, *([apart] if apart else [])))
        spans = points.groupBy("model_id").agg(F.count("*").alias("points"), *[F.min(c).alias(f"from_{c}") for c in "xyz"], *[F.max(c).alias(f"to_{c}") for c in "xyz"])
        self.spans = stored(spans, "spans")
        models, n = self.spans.agg(F.count("*"), F.coalesce(F.sum("points"), F.lit(0))).collect()[0]
        self.largest = self.spans.agg(F.coalesce(F.max("points"), F.lit(0))).collect()[0][0]
        size = size or max(LEAST_BLOCK, min(BLOCK, -(-n // WANTED)))
        self.many = max(1, -(-n // size))
        spans = self.spans if models > FEW else F.broadcast(self.spans)
        span = F.nullif(F.greatest(*[F.col(f"to_{c}") - F.col(f"from_{c}") for c in "xyz"]), F.lit(0.0))
        steps = {f"i{c}": F.coalesce(F.least(F.floor((F.col(c) - F.col(f"from_{c}")) / span * 2**BITS), F.lit(2**BITS - 1)), F.lit(0)) for c in "xyz"}
        # Bits of each axis spread out, two free ones after each.
        spread = F.array(*[F.col(f"i{c}").cast("long") for c in "xyz"])
        for shift, mask in ((16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249)):
            spread = F.transform(spread, _spreading(shift, mask))
        code = F.aggregate(F.reverse(spread), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 1).bitwiseOR(v))
        coded = points.join(spans, "model_id").withColumns(steps).withColumn("code", code)
        dealt = coded.repartitionByRange(self.many, "model_id", *([apart] if apart else []), "code", "x", "point_id").withColumn("block", F.spark_partition_id())
        self.placed = stored(dealt.select("model_id", "block", "point_id", "x", "y", "z", *more), "blocks")
        boxes = self.placed.groupBy("model_id", "block").agg(F.count("*").alias("n"), *[F.min(c).alias(f"low_{c}") for c in "xyz"], *[F.max(c).alias(f"high_{c}") for c in "xyz"])
        self.boxes = stored(boxes, "boxes")
        self.more = more
        self.kinds = dict(self.placed.dtypes)
        self.sent = None

    def pairs(self, reach, bounds: DataFrame | None = None) -> DataFrame:
        """model_id, s, t, part: blocks not farther apart than ``reach`` (a column; None: all), t's dealt into parts of ``HELD`` points."""
        own = self.boxes if bounds is None else self.boxes.join(bounds, ["model_id", "block"])
        s = own.select("model_id", F.col("block").alias("s"), *[F.col(f"{e}_{c}").alias(f"s_{e}_{c}") for e in ("low", "high") for c in "xyz"], *([] if bounds is None else ["bound"]))
        t = self.boxes.withColumnRenamed("block", "t")
        both = s.join(F.broadcast(t) if self.many <= FEW // 2 else t, "model_id")
        if reach is not None:
            gap = [F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"s_high_{c}"), F.col(f"s_low_{c}") - F.col(f"high_{c}")) for c in "xyz"]
            both = both.where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= reach * reach * (1 + 1e-9))
        return self.parted(both)

    def parted(self, both: DataFrame, held: int | None = None) -> DataFrame:
        """Pairs of blocks (model_id, s, t, n points of t) with the part of s's work items that t is in, of at most about ``held`` points."""
        before = Window.partitionBy("model_id", "s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / (held or HELD)).cast("int")
        return stored(both.select("model_id", "s", "t", part.alias("part")), "pairs")

    def packed(self) -> DataFrame:
        """model_id, block, points: a block's ids and numbers as one value (an Arrow stream), so that work items are few rows however many points they meet."""
        if self.sent is None or self.sent[0] is not self.placed:
            names = ["point_id", "x", "y", "z", *self.more]

            def pack(table: pa.Table) -> pa.Table:
                sink, points = pa.BufferOutputStream(), table.select(names)
                with pa.ipc.new_stream(sink, points.schema) as stream:
                    stream.write_table(points)
                return table.select(["model_id", "block"]).slice(0, 1).append_column("points", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

            made = self.placed.select("model_id", "block", *names).groupBy("model_id", "block").applyInArrow(pack, f"model_id {self.kinds['model_id']}, block int, points binary")
            self.sent = self.placed, stored(made, "packed")
        return self.sent[1]

    def items(self, pairs: DataFrame) -> DataFrame:
        """Rows of work items (model_id, s, part), one a block: its own points with the model's middle, and the blocks to meet."""
        few = lambda df: F.broadcast(df) if self.many <= 1000 else df
        middle = F.array(*[(F.col(f"from_{c}") + F.col(f"to_{c}")) / 2 for c in "xyz"]).alias("middle")
        each = pairs.select("model_id", "s", "part").distinct().join(self.spans, "model_id").select("model_id", "s", "part", middle)
        own = self.packed().withColumnRenamed("block", "s").join(few(each), ["model_id", "s"]).select("model_id", "s", "part", F.lit(OWN).cast("byte").alias("kind"), "points", "middle")
        other = self.packed().withColumnRenamed("block", "t").join(few(pairs), ["model_id", "t"]).select("model_id", "s", "part", F.lit(OTHER).cast("byte").alias("kind"), "points", F.lit(None).cast("array<double>").alias("middle"))
        # Few bytes and much work: a count of its own, so that work items are not put together.
        tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(self.many, 2000))
        return own.unionByName(other).repartition(tasks, "model_id", "s", "part")

    def each(self, pairs: DataFrame, work, schema: str, models: bool = True) -> DataFrame:
        """``work`` yields lists of columns for an item: (ids, places and more columns of own, of other, the model's middle, the block); model_id comes first if ``models``."""
        schema = f"model_id {self.kinds['model_id']}, {schema}" if models else schema
        names = [c.split(" ")[0] for c in schema.split(", ")]
        width, types = 3 + len(self.more), {"block": pa.int32()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches))
            model, which = held.column(0).slice(0, 1).combine_chunks(), held.column(3).to_numpy()
            middle = np.array(held.column(5)[int(np.flatnonzero(which == OWN)[0])].as_py(), float)
            sides = []
            for side in (OWN, OTHER):
                points = pa.concat_tables([pa.ipc.open_stream(held.column(4)[int(i)].as_buffer()).read_all() for i in np.flatnonzero(which == side)])
                numbers = np.column_stack([points.column(1 + i).to_numpy() for i in range(width)])
                at = np.argsort(z_order(numbers[:, :3]), kind="stable")
                sides.append((pa.concat_arrays(points.column(0).chunks).take(pa.array(at)), numbers[at]))
            for columns in work(*sides, middle, held.column(1)[0].as_py()):
                n = len(columns[0])
                if n:
                    columns = [*([model.take(pa.array(np.zeros(n, np.int64)))] if models else []), *columns]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types.get(name)) for c, name in zip(columns, names, strict=True)], names)

        return self.items(pairs).groupBy("model_id", "s", "part").applyInArrow(run, schema)


def _spreading(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))


def z_order(places: np.ndarray) -> np.ndarray:
    """Place of each point on a Z-curve of ten bits an axis through the cube around all."""
    if not len(places):
        return np.zeros(0, np.int64)
    low, span = places.min(axis=0), np.ptp(places, axis=0).max()
    steps = np.minimum((places - low) / (span or 1) * 1024, 1023).astype(np.int64)
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        steps = (steps | steps << shift) & mask
    return steps[:, 0] | steps[:, 1] << 1 | steps[:, 2] << 2


def runs(n: int, size: int) -> np.ndarray:
    return np.arange(0, n, size)


class Leaves:
    """Boxes of runs of ``LEAF`` points."""

    def __init__(self, places: np.ndarray):
        self.places, self.starts = places, runs(len(places), LEAF)
        self.low, self.high = (f.reduceat(places, self.starts, axis=0) if len(places) else places for f in (np.minimum, np.maximum))
        self.sizes = np.diff(np.append(self.starts, len(places)))

    def gaps(self, some: np.ndarray, far: bool = False):
        """Squares of the least (and largest) distance from the box of ``some`` to each leaf's."""
        low, high = some.min(axis=0), some.max(axis=0)
        near = np.maximum(np.maximum(self.low - high, low - self.high), 0)
        near = np.einsum("ij,ij->i", near, near)
        if not far:
            return near
        wide = np.maximum(self.high - low, high - self.low)
        return near, np.einsum("ij,ij->i", wide, wide)

    def points(self, chosen: np.ndarray) -> np.ndarray:
        """Numbers of the points of chosen leaves."""
        size = self.sizes[chosen]
        return np.repeat(self.starts[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())


def squares(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, added up in the order x, y, z."""
    d = some[:, 0, None] - others[None, :, 0]
    out = d * d
    for i in (1, 2):
        d = some[:, i, None] - others[None, :, i]
        out += d * d
    return out


def ball_sums(own: np.ndarray, others: np.ndarray, values: np.ndarray, squared: list[float]) -> np.ndarray:
    """Sums of the others' ``values`` within each squared radius of each own point: (own, radius, value).

    A matrix product tells squared distances but for its rounding, with half of the digits
    where own points are not far apart for the radii; only those that this leaves in doubt are
    looked at exactly.  All steps write into the same arrays, as new ones of this size cost
    more than what is done with them.
    """
    out = np.zeros((len(own), len(squared), values.shape[1]))
    if not len(others):
        return out
    leaves = Leaves(others)
    sums = np.add.reduceat(values, leaves.starts, axis=0)
    # Leaves as rows of ``LEAF`` points, the last one filled up with what adds nothing.
    fill = len(leaves.starts) * LEAF - len(others)
    filled = np.vstack((others, np.repeat(others[-1:], fill, axis=0)))
    of_leaf = np.vstack((values, np.zeros((fill, values.shape[1])))).reshape(len(leaves.starts), -1)
    middle = (own.min(axis=0) + own.max(axis=0)) / 2
    p, q = own - middle, filled - middle
    own_size, q_size = (p * p).sum(axis=1), (q * q).sum(axis=1)
    widest = (math.sqrt(own_size.max()) + math.sqrt(max(squared))) ** 2
    kind, rounding = (np.float32, 2e-6) if 4e-6 * widest <= 1e-3 * min(squared) else (np.float64, 1e-14)
    left = np.ascontiguousarray(np.column_stack((-2 * p, own_size, np.ones(len(p)))), kind)
    right = np.ascontiguousarray(np.vstack((q.T, np.ones(len(q)), q_size)), kind).reshape(5, -1, LEAF)
    q_most = q_size.reshape(-1, LEAF).max(axis=1)
    room = SUMMED * TOGETHER * LEAF
    space, bits, within_all, inside = np.empty(room, kind), np.empty((2, room), bool), np.empty(room), np.empty((len(squared), len(sums)))
    for start in runs(len(own), SUMMED):
        rows = slice(start, start + SUMMED)
        some, at = own[rows], out[rows]
        near, far = leaves.gaps(some, far=True)
        # Which radii each leaf is cut by, as bits: leaves that are cut by the same ones go together.
        cut = np.zeros(len(near), np.int64)
        for k, r2 in enumerate(squared):
            inside[k] = far <= r2 * (1 - 1e-9)
            cut |= ((inside[k] == 0) & (near <= r2 * (1 + 1e-9))).astype(np.int64) << k
        at += inside @ sums
        most = own_size[rows].max()
        for pattern in np.unique(cut[cut > 0]):
            chosen = np.flatnonzero(cut == pattern)
            for few in np.split(chosen, range(TOGETHER, len(chosen), TOGETHER)):
                shape = len(some), len(few) * LEAF
                d2, sure, maybe, within = (x[: shape[0] * shape[1]].reshape(shape) for x in (space, *bits, within_all))
                np.matmul(left[rows], right.take(few, axis=1).reshape(5, -1), out=d2)
                slack, value = rounding * (most + q_most[few].max()), of_leaf.take(few, axis=0).reshape(shape[1], -1)
                for k, r2 in enumerate(squared):
                    if pattern >> k & 1:
                        np.less_equal(d2, kind(r2 - slack), out=sure)
                        np.less_equal(d2, kind(r2 + slack), out=maybe)
                        if np.count_nonzero(sure) < np.count_nonzero(maybe):
                            i, j = np.divmod(np.flatnonzero(np.not_equal(sure, maybe, out=maybe)), shape[1])
                            d = some[i] - filled[few[j // LEAF] * LEAF + j % LEAF]
                            sure[i, j] = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2] <= r2
                        within[:] = sure
                        at[:, k] += within @ value
    return out


def around(points: DataFrame, squared: list[float], raw: bool = True, mid: bool = True) -> DataFrame:
    """Per point and squared radius k: n{k} neighbours (the point included), their raw second moment raw{k}xx ... and covariance mid{k}xx ...

    Covariances are summed about the model's middle.
    """
    made = Blocks(points)
    names = ["n", *([f"raw{c}" for c in SIX] if raw else []), *([f"s{c}" for c in "xyz"] + [f"mid{c}" for c in SIX] if mid else [])]
    columns = [f"{n}_{k}" for k in range(len(squared)) for n in names]

    def work(own, other, middle, block):
        p = other[1] - middle if mid else other[1]
        parts = [np.ones((len(p), 1)), *([p] if mid else []), *([np.column_stack([p[:, a] * p[:, b] for a, b in PAIRS])] if raw or mid else [])]
        got = ball_sums(own[1], other[1], np.hstack(parts), squared)
        if raw and mid:
            # Sums about the origin follow from those about the middle.
            n, s = got[:, :, 0], got[:, :, 1:4]
            moved = [got[:, :, 4 + i] + middle[a] * s[:, :, b] + middle[b] * s[:, :, a] + middle[a] * middle[b] * n for i, (a, b) in enumerate(PAIRS)]
            got = np.concatenate((n[:, :, None], np.stack(moved, axis=2), got[:, :, 1:]), axis=2)
        yield [own[0], *got.reshape(len(own[1]), -1).T.copy()]

    pairs = made.pairs(F.lit(math.sqrt(max(squared))))
    sums = made.each(pairs, work, ", ".join([f"src {made.kinds['point_id']}", *[f"{c} double" for c in columns]]))
    if not pairs.where("part > 0").isEmpty():
        sums = sums.groupBy("model_id", "src").agg(*[F.sum(c).alias(c) for c in columns])
    out = []
    for k in range(len(squared)):
        n = F.nullif(F.col(f"n_{k}"), F.lit(0.0))
        out.append(F.col(f"n_{k}").cast("long").alias(f"n{k}"))
        out += [(F.col(f"raw{c}_{k}") / n).alias(f"raw{k}{c}") for c in SIX] if raw else []
        out += [(F.col(f"mid{c}_{k}") / n - F.col(f"s{c[0]}_{k}") / n * (F.col(f"s{c[1]}_{k}") / n)).alias(f"mid{k}{c}") for c in SIX] if mid else []
    # Written, as what follows uses each number many times.
    return stored(sums.select("model_id", "src", *out), "moments")


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Values of at least zero as SQL rounds doubles: whole ones of their product with a power of ten, halves up, and divided again."""
    scaled = values * 10.0**digits
    whole = np.floor(scaled)
    whole += scaled - whole >= 0.5
    whole /= 10.0**digits
    return np.where(np.isfinite(whole), whole, values)


def near_pairs(points: DataFrame, radius: float, places: bool = True, digits: int | None = None, models: bool = True) -> DataFrame:
    """All (src, dst) within ``radius``, itself included: model_id (if ``models``), src, dst, d2 and, if wanted, the neighbour's place.

    d2 is rounded to ``digits`` here if they are given: Spark's own rounding takes more time
    than all the rest.
    """
    made = Blocks(points)
    kind, r2 = made.kinds["point_id"], radius * radius

    def work(own, other, middle, block):
        leaves, across = Leaves(other[1]), np.ascontiguousarray(other[1].T)
        # All steps write into the same arrays, as new ones of this size cost more than what is done with them.
        room = RUN * TOGETHER * leaves.sizes.max(initial=0)
        space, near = np.empty((2, room)), np.empty(room, bool)
        for start in runs(len(own[1]), RUN):
            some = own[1][start : start + RUN]
            src, chosen = own[0].slice(start, len(some)), np.flatnonzero(leaves.gaps(some) <= r2 * (1 + 1e-9))
            for few in np.split(chosen, range(TOGETHER, len(chosen), TOGETHER)):
                at = leaves.points(few)
                shape = len(some), len(at)
                d2, d, within = (x[: shape[0] * shape[1]].reshape(shape) for x in (*space, near))
                for a, place in enumerate(across.take(at, axis=1)):
                    np.subtract(some[:, a, None], place, out=d if a else d2)
                    if a:
                        d2 += np.multiply(d, d, out=d)
                    else:
                        d2 *= d2
                np.less_equal(d2, r2, out=within)
                found = np.flatnonzero(within)
                i = np.repeat(np.arange(len(some)), np.count_nonzero(within, axis=1))
                dst, far = at.take(found - i * len(at)), d2.ravel().take(found)
                yield [src.take(pa.array(i)), other[0].take(pa.array(dst)), far if digits is None else half_up(far, digits), *([across[a].take(dst) for a in range(3)] if places else [])]

    schema = f"src {kind}, dst {kind}, d2 double" + (", dx double, dy double, dz double" if places else "")
    return made.each(made.pairs(F.lit(float(radius))), work, schema, models)


def nearest(own, other, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest others of other ids of each own point, ties by id: their rows (own, other) and squared distances, in order."""
    ids = other[0].to_numpy(zero_copy_only=False)
    own_ids = own[0].to_numpy(zero_copy_only=False)
    leaves = Leaves(other[1])
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def met(start, chosen):
        at = leaves.points(chosen)
        d2 = squares(own[1][start : start + RUN], other[1][at])
        d2[own_ids[start : start + RUN, None] == ids[None, at]] = np.inf
        return at, d2

    for start in runs(len(own[1]), RUN) if len(ids) else ():
        gaps = leaves.gaps(own[1][start : start + RUN])
        few = -(-4 * (k + 1) // LEAF) + 4
        chosen = np.argpartition(gaps, few)[:few] if few < len(gaps) else np.arange(len(gaps))
        at, d2 = met(start, chosen)
        if few < len(gaps):
            bound = np.partition(d2, k - 1, axis=1)[:, k - 1].max()
            at, d2 = met(start, np.flatnonzero(gaps <= bound * (1 + 1e-9)))
        last = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
        i, j = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
        order = np.lexsort((ids[at[j]], d2[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(d2)))
        kept = np.arange(len(i)) - first[i] < k
        out.append((i[kept] + start, at[j[kept]], d2[i[kept], j[kept]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def k_nearest(points: DataFrame, k: int) -> DataFrame:
    """The k nearest others of a model, ties by id: model_id, src, dst, d2, rank.

    How far a block must look is what its farthest k-th neighbour within the block itself says.
    """
    made = Blocks(points)
    kind = made.kinds["point_id"]

    def reach(own, other, middle, block):
        i, _, d2 = nearest(own, other, k)
        full = len(own[1]) and (np.bincount(i, minlength=len(own[1])) == k).all()
        yield [[block], [float(np.sqrt(d2.max())) if full else float("inf")]]

    def work(own, other, middle, block):
        i, j, d2 = nearest(own, other, k)
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        yield [own[0].take(pa.array(i)), other[0].take(pa.array(j)), d2, rank.astype(np.int32)]

    alone = made.boxes.select("model_id", F.col("block").alias("s"), F.col("block").alias("t"), F.lit(0).alias("part"))
    bounds = stored(made.each(alone, reach, "block int, bound double"), "bounds")
    pairs = made.pairs(F.col("bound"), bounds)
    found = made.each(pairs, work, f"src {kind}, dst {kind}, d2 double, rank int")
    if pairs.where("part > 0").isEmpty():
        return found
    rank = F.row_number().over(Window.partitionBy("model_id", "src").orderBy("d2", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def touching(sides: DataFrame, r2: float) -> DataFrame:
    """model_id, a, b of those groups of rows (model_id, a, b, end, x, y, z) whose ends "a" and "b" have a point each within the squared radius."""
    kinds = dict(sides.dtypes)

    def run(table: pa.Table) -> pa.Table:
        end = table.column("end").to_numpy()
        places = np.column_stack([table.column(c).to_numpy() for c in "xyz"])
        some, other = (p[np.argsort(z_order(p))] for p in (places[end == "a"], places[end == "b"]))
        leaves, found = Leaves(other), False
        for start in runs(len(some), RUN):
            gaps = leaves.gaps(some[start : start + RUN])
            chosen = np.flatnonzero(gaps <= r2)
            chosen = chosen[np.argsort(gaps[chosen])]
            found = any((squares(some[start : start + RUN], other[leaves.points(few)]) <= r2).any() for few in np.split(chosen, range(TOGETHER, len(chosen), TOGETHER)) if len(few))
            if found:
                break
        return table.select(["model_id", "a", "b"]).slice(0, int(found))

    return sides.groupBy("model_id", "a", "b").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("model_id", "a", "b")))
