"""What may lie in a cone: pairs of cells left after pruning a pyramid of cells from the top.

Items (points, or facets with their boxes) of a model are put into cells of a cubic grid,
apart by the axis that their normal is nearest to (or by having none).  A cell is known by the bounds of its
places and of its normals, which merge by minimum and maximum, so coarser cells are sums of
finer ones.  From the one pair of whole models, level by level, each pair of cells is
replaced by the pairs of their children, by an equi-join on the parents, and a pair goes if
no place of the second can be in the cone of any item of the first, or, if wanted, if no
two of their normals face away from each other.  So what is compared item by item follows
from what cones really hold, and nothing that a cone holds is lost.

How fine a model's cells are follows from its items: as fine as leaves at least
``leaf`` of them in a cell on average.

Shape diameters of points (``diameters``) take blocks of points in place of cells: Spark deals
out blocks of like size, pairs of blocks are pruned by the same bounds, and numpy meets runs of
a block's points with leaves of what is left.  What a cone holds is looked at where it is found,
so hits are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import blocks
from .spatial import stored

#: Items in a cell of the finest level, on average at least, and the finest level there is.
LEAF, FINEST = 32, 10
#: Radians by which angles of cells may be wrong.
SLACK = 1e-6
#: Points that a work item of ``diameters`` meets, points met in one step, pairs of a run of sources and what it meets, and marks that tell where a median is.
MET, TOGETHER, HITS, MARKS = 1 << 20, 1024, 1 << 24, 128
BOUNDS = [f"{end}_{c}" for c in ("x", "y", "z", "ux", "uy", "uz") for end in ("low", "high")]


def unit_normals(items: DataFrame) -> DataFrame:
    """Adds ux, uy, uz, zero where a normal is; items without a whole place and normal are left out, as no cone holds them."""
    whole = items
    for c in ("x", "y", "z", "nx", "ny", "nz"):
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    size = F.nullif(F.sqrt(G.dot(n, n)), F.lit(0.0))
    return whole.withColumns({f"u{c}": F.coalesce(F.col(f"n{c}") / size, F.lit(0.0)) for c in "xyz"})


def by_side():
    """Which axis, and which end of it, a normal is nearest to; 6 without a normal."""
    largest = F.greatest(*[F.abs(f"u{c}") for c in "xyz"])
    side = F.when(largest == 0, 6)
    for i, c in enumerate("xyz"):
        side = side.when(F.abs(f"u{c}") == largest, 2 * i + (F.col(f"u{c}") < 0).cast("int"))
    return side


def _key(shift):
    """A cell's key at ``shift`` levels above the model's finest."""
    up = lambda c: F.call_function("shiftright", F.col(c), shift)
    return ((up("ix") * 2**FINEST + up("iy")) * 2**FINEST + up("iz")) * 8 + F.col("side")


def placed(items: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Adds to items (model_id, x, y, z, ux, uy, uz) their cell at the model's finest level: level, ix, iy, iz, side, cell."""
    spans = items.groupBy("model_id").agg(*[F.min(c).alias(f"from_{c}") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("span"))
    fine = items.join(spans, "model_id").withColumn("side", by_side())
    steps = lambda c: F.least(F.floor((F.col(c) - F.col(f"from_{c}")) / F.nullif(F.col("span"), F.lit(0.0)) * 2**FINEST), F.lit(2**FINEST - 1))
    fine = fine.withColumns({f"i{c}": F.coalesce(steps(c), F.lit(0)).cast("long") for c in "xyz"})
    # Cells in use at each level, about; the finest level with enough items a cell is taken.
    used = [F.hll_sketch_estimate(F.hll_sketch_agg(_key(F.lit(FINEST - level)), 10)).alias(f"l{level}") for level in range(1, FINEST + 1)]
    levels = fine.groupBy("model_id").agg(F.count("*").alias("n"), *used)
    enough = [F.when(F.col(f"l{level}") * leaf <= F.col("n"), level).otherwise(0) for level in range(1, FINEST + 1)]
    fine = fine.join(levels.select("model_id", F.greatest(*enough).alias("level")), "model_id")
    fine = fine.withColumns({f"i{c}": F.call_function("shiftright", F.col(f"i{c}"), FINEST - F.col("level")) for c in "xyz"})
    return fine.withColumn("cell", _key(F.lit(0))).drop("span", "from_x", "from_y", "from_z")


def cells(items: DataFrame, box: bool = False) -> DataFrame:
    """Bounds of the cells of placed items; with ``box`` items have bounds of their own (low_x, high_x ...) in place of a point."""
    place = [agg(F.col(f"{end}_{c}") if box else F.col(c)).alias(f"{end}_{c}") for c in "xyz" for end, agg in (("low", F.min), ("high", F.max))]
    turn = [agg(c).alias(f"{end}_{c}") for c in ("ux", "uy", "uz") for end, agg in (("low", F.min), ("high", F.max))]
    return items.groupBy("model_id", "level", "ix", "iy", "iz", "side").agg(F.count("*").alias("n"), *place, *turn)


def _level(found: DataFrame, level: int) -> DataFrame:
    """model_id, key, parent, middle and reach of the places, axis and spread of the normals, n: of cells at a level."""
    above = lambda k: F.greatest(F.col("level") - k, F.lit(0))
    merged = found.select("model_id", _key(above(level)).alias("key"), _key(above(level - 1)).alias("parent"), "n", *BOUNDS)
    merged = merged.groupBy("model_id", "key", "parent").agg(F.sum("n").alias("n"), *[(F.min if b.startswith("low") else F.max)(b).alias(b) for b in BOUNDS])
    return _bounded(merged, "model_id", "key", "parent", "n")


def _bounded(merged: DataFrame, *keep: str) -> DataFrame:
    """``keep``, middle and reach of the places, axis and spread of the normals of rows with bounds."""
    half = lambda names: F.sqrt(G.sum_of((F.col(f"high_{c}") - F.col(f"low_{c}")) ** 2 for c in names)) / 2
    middle = {c: (F.col(f"high_{c}") + F.col(f"low_{c}")) / 2 for c in ("x", "y", "z", "ux", "uy", "uz")}
    out = merged.select(*keep, *[m.alias(c) for c, m in middle.items()], half("xyz").alias("reach"), half(("ux", "uy", "uz")).alias("chord"))
    length = F.sqrt(G.sum_of(F.col(f"u{c}") * F.col(f"u{c}") for c in "xyz"))
    # Unit vectors within a chord of the middle are within this angle of its direction.
    cosine = (1 + length * length - F.col("chord") * F.col("chord")) / F.nullif(2 * length, F.lit(0.0))
    spread = F.coalesce(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))), F.lit(math.pi))
    direction = {f"u{c}": F.coalesce(F.col(f"u{c}") / F.nullif(length, F.lit(0.0)), F.lit(0.0)) for c in "xyz"}
    return out.withColumns({"spread": spread} | {f"d{c}": v for c, v in direction.items()}).select(
        *keep, F.array("x", "y", "z").alias("at"), "reach", F.array("dux", "duy", "duz").alias("along"), "spread"
    )


def _may_meet(cone: float, facing: bool):
    at, to, along, other = ([F.get(F.col(c), F.lit(i)) for i in range(3)] for c in ("s_at", "t_at", "s_along", "t_along"))
    angle = lambda cosine: F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
    way = [b - a for a, b in zip(at, to, strict=True)]
    far = F.sqrt(G.dot(way, way))
    reach = F.col("s_reach") + F.col("t_reach")
    apart = far > reach * (1 + 1e-9) + 1e-12
    off = angle(-G.dot(way, along) / F.nullif(far, F.lit(0.0))) - F.asin(F.least(reach / F.nullif(far, F.lit(0.0)), F.lit(1.0)))
    keep = ~apart | (off <= math.radians(cone) + F.col("s_spread") + SLACK)
    if facing:
        keep = keep & (angle(G.dot(along, other)) + F.col("s_spread") + F.col("t_spread") >= math.pi / 2 - SLACK)
    return keep


def cell_pairs(sources: DataFrame, targets: DataFrame, cone: float, facing: bool) -> DataFrame:
    """model_id, s, t and their items n_s, n_t: finest cells of ``sources`` and ``targets`` (from ``cells``) that must be compared.

    ``cone``: degrees around the inward normal that are looked at; ``facing``: normals must be
    at a right angle at least.
    """
    same = targets is None or targets is sources
    sources = stored(sources, "cells")
    targets = sources if same else stored(targets, "cells")
    finest = max(df.agg(F.coalesce(F.max("level"), F.lit(0))).collect()[0][0] for df in (sources, targets))
    names = ("n", "at", "reach", "along", "spread")
    side = lambda df, p, level: _level(df, level).select("model_id", F.col("key").alias(p), F.col("parent").alias(f"{p}_up"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    keep = _may_meet(cone, facing)
    pairs = side(sources, "s", 0).drop("s_up").join(side(targets, "t", 0).drop("t_up"), "model_id").where(keep).select("model_id", "s", "t", "s_n", "t_n")
    for level in range(1, finest + 1):
        up = pairs.select("model_id", F.col("s").alias("s_up"), F.col("t").alias("t_up"))
        below = up.join(side(sources, "s", level), ["model_id", "s_up"]).join(side(targets, "t", level), ["model_id", "t_up"])
        pairs = below.where(keep).select("model_id", "s", "t", "s_n", "t_n")
    return pairs


def block_pairs(made: blocks.Blocks, bounds: DataFrame, cone: float, facing: bool, held: int) -> DataFrame:
    """Pairs of blocks that must be compared, as ``Blocks.pairs``; bounds: model_id, block and n, and bounds of the sources' places, of the targets' (with ``to_``) and of normals."""
    names = ("at", "reach", "along", "spread")
    given = {"s": bounds, "t": bounds.withColumns({b: F.col(f"to_{b}") for b in BOUNDS if f"to_{b}" in bounds.columns})}
    s, t = (_bounded(df, "model_id", "block", "n").select("model_id", F.col("block").alias(p), *(["n"] if p == "t" else []), *[F.col(c).alias(f"{p}_{c}") for c in names]) for p, df in given.items())
    both = s.join(F.broadcast(t) if made.many <= blocks.FEW // 2 else t, "model_id").where(_may_meet(cone, facing))
    return made.parted(both, held)


def normal_sides(unit: np.ndarray) -> np.ndarray:
    """``by_side`` of unit normals."""
    axis = np.abs(unit).argmax(axis=1)
    return np.where(unit.any(axis=1), 2 * axis + (unit[np.arange(len(unit)), axis] < 0), 6)


class Faced:
    """Places and unit normals in runs of ``size``, with the middle and reach of a run's places and the axis and spread of its normals."""

    def __init__(self, places: np.ndarray, unit: np.ndarray, size: int):
        self.starts = blocks.runs(len(places), size)
        self.sizes = np.diff(np.append(self.starts, len(places)))
        low, high = (f.reduceat(places, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.at, self.reach = (low + high) / 2, np.linalg.norm(high - low, axis=1) / 2
        self.along = np.add.reduceat(unit, self.starts, axis=0)
        length = np.linalg.norm(self.along, axis=1)
        self.along /= np.maximum(length, 1e-300)[:, None]
        cosine = np.minimum.reduceat((unit * np.repeat(self.along, self.sizes, axis=0)).sum(axis=1), self.starts)
        self.spread = np.where(length > 1e-9, np.arccos(np.clip(cosine, -1, 1)), math.pi)

    def may_meet(self, k: int, others: Faced, cone: float, facing: bool) -> np.ndarray:
        """Of the others' runs those that a cone of run ``k`` may hold."""
        way = others.at - self.at[k]
        far, reach = np.linalg.norm(way, axis=1), others.reach + self.reach[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.arccos(np.clip(-(way @ self.along[k]) / far, -1, 1)) - np.arcsin(np.minimum(reach / far, 1))
        keep = ~(far > reach * (1 + 1e-9) + 1e-12) | (off <= math.radians(cone) + self.spread[k] + SLACK)
        if facing:
            keep &= np.arccos(np.clip(others.along @ self.along[k], -1, 1)) + self.spread[k] + others.spread >= math.pi / 2 - SLACK
        return np.flatnonzero(keep)

    def points(self, chosen: np.ndarray) -> np.ndarray:
        size = self.sizes[chosen]
        return np.repeat(self.starts[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())


def by_normal(side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, places, normals and more numbers of one side of a work item, those with normals of one side together, and their unit normals."""
    ids, numbers = side
    normal = numbers[:, 3:6]
    unit = normal / np.maximum(np.linalg.norm(normal, axis=1), 1e-300)[:, None]
    order = np.argsort(normal_sides(unit), kind="stable")
    return ids.take(pa.array(order)), numbers[order], unit[order]


def each_source(own, other, cone: float, leaf: int):
    """Place in own, distances and angles (degrees) of all that its cone holds, of each source that holds something.

    Matrix products tell, with some slack, what cones of a run of sources may hold; source by
    source only that is looked at exactly, so no more than one source's hits are held.
    """
    (ids, p, u), (other_ids, q, w) = own, other
    if not len(p) or not len(q):
        return
    known, other_known = ids.to_numpy(zero_copy_only=False), other_ids.to_numpy(zero_copy_only=False)
    by_id = np.argsort(other_known, kind="stable")
    same = [np.searchsorted(other_known, known, side, sorter=by_id) for side in ("left", "right")]
    middle = (q[:, :3].min(axis=0) + q[:, :3].max(axis=0)) / 2
    scale = max(float(np.abs(x[:, :3] - middle).max()) for x in (p, q)) or 1.0
    a, b = (p[:, :3] - middle) / scale, (q[:, :3] - middle) / scale
    # Halves of the digits do where most places are not close together for the scale.
    kind, slack = (np.float32, 2e-6) if np.median(np.abs(b)) > 0.02 else (np.float64, 1e-12)
    cos2 = math.cos(math.radians(cone)) ** 2
    # With the slack taken in: how far ahead something is, and the square of how far it must be.
    ahead = np.column_stack((-u, (u * a).sum(axis=1) + slack)).astype(kind)
    least = np.column_stack((-2 * cos2 * a, cos2 * (a * a).sum(axis=1) - 10 * slack, np.full(len(a), cos2))).astype(kind)
    unit = u.astype(kind)
    met = np.ascontiguousarray(np.column_stack((b, np.ones(len(b)), (b * b).sum(axis=1), w)).T, kind)
    exact = np.ascontiguousarray(q[:, :6].T)
    leaves, size = Faced(q[:, :3], w, leaf), int(min(max(HITS // len(q), 8), blocks.RUN))
    runs = Faced(p[:, :3], u, size)
    # All steps write into the same arrays, as new ones of this size cost more than what is done with them.
    space, bits, held = np.empty((2, size * TOGETHER), kind), np.empty((2, size * TOGETHER), bool), np.empty(size * len(q), bool)
    of_run, near_run, of_source = np.empty(len(met) * len(q), kind), np.empty(6 * len(q)), np.empty(6 * len(q))
    columns = lambda rows, at, into: rows.take(at, axis=1, out=into[: len(rows) * len(at)].reshape(len(rows), -1), mode="clip")
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    for k, start in enumerate(runs.starts):
        rows, n = slice(start, start + runs.sizes[k]), runs.sizes[k]
        chosen = leaves.points(runs.may_meet(k, leaves, cone, facing=True))
        if not len(chosen):
            continue
        may, some, near = held[: n * len(chosen)].reshape(n, -1), columns(met, chosen, of_run), columns(exact, chosen, near_run)
        for at in range(0, len(chosen), TOGETHER):
            part = some[:, at : at + TOGETHER]
            x, y, behind, beside = (v[: n * part.shape[1]].reshape(n, -1) for v in (*space, *bits))
            np.matmul(unit[rows], part[5:], out=x)
            np.greater(x, kind(slack), out=behind)
            if cone < 90:
                np.matmul(ahead[rows], part[:4], out=x)
                np.matmul(least[rows], part[:5], out=y)
                with np.errstate(invalid="ignore"):
                    # Of what is near enough for the slack to matter there is no root, and it stays.
                    np.less(x, np.sqrt(y, out=y), out=beside)
                np.logical_or(behind, beside, out=behind)
            np.logical_not(behind, out=may[:, at : at + TOGETHER])
        for i in range(start, start + n):
            its = by_id[same[0][i] : same[1][i]]
            at = np.minimum(np.searchsorted(chosen, its), len(chosen) - 1)
            may[i - start, at[chosen[at] == its]] = False
            j = np.flatnonzero(may[i - start])
            if not len(j):
                continue
            x, y = p[i], columns(near, j, of_source)
            v = [y[c] - x[c] for c in range(3)]
            d = np.sqrt(dot(v, v))
            with np.errstate(divide="ignore", invalid="ignore"):
                angle = np.degrees(np.arccos(np.clip(-dot(v, x[3:]) / (d * np.sqrt(dot(x[3:], x[3:]))), -1, 1)))
            good = np.flatnonzero((angle > 0) & (angle <= cone) & (dot(x[3:], y[3:]) <= 0))
            if len(good):
                yield i, d.take(good), angle.take(good)


def middle_of(d: np.ndarray) -> float:
    """The median."""
    k = len(d) // 2
    parted = np.partition(d, k)
    return parted[k] if len(d) % 2 else (parted[:k].max() + parted[k]) / 2


def diameters(given: DataFrame, cone: float, leaf: int = LEAF) -> DataFrame:
    """model_id, src, sdf of all points (with unit normals) whose cones hold something.

    Where a block may meet more than ``MET`` points, these are dealt into parts.  Marks of each
    part's sorted distances then tell between which two the median is, a second pass has all
    between these, and a third adds up what is near the median.
    """
    more = ("nx", "ny", "nz")
    made = blocks.Blocks(given.withColumns({c: F.col(c).cast("double") for c in more} | {"apart": by_side()}), more, apart="apart")
    n = [F.col(c) for c in more]
    size = F.nullif(F.sqrt(G.dot(n, n)), F.lit(0.0))
    turn = [agg(F.coalesce(F.col(f"n{c}") / size, F.lit(0.0))).alias(f"{end}_u{c}") for c in "xyz" for end, agg in (("low", F.min), ("high", F.max))]
    bounds = made.boxes.join(made.placed.groupBy("model_id", "block").agg(*turn), ["model_id", "block"])
    pairs = block_pairs(made, bounds, cone, True, MET)
    kind = made.kinds["point_id"]

    def run(columns, row, schema):
        def work(own, other, middle, block):
            own, other = by_normal(own), by_normal(other)
            at, out = [], [[] for _ in columns]
            for i, d, angle in each_source(own, other, cone, leaf):
                at.append(i)
                for c, x in zip(out, row(own[1][i], d, angle), strict=True):
                    c.append(x)
            if at:
                yield [own[0].take(pa.array(np.array(at))), *out]

        return made.each(pairs, work, f"src {kind}, {schema}")

    def near(d, angle, median, deviation):
        kept = np.flatnonzero(np.abs(d - median) <= deviation + 1e-8)
        angle = angle.take(kept)
        return (d.take(kept) / angle).sum(), (1 / angle).sum()

    def whole(own, d, angle):
        a, b = near(d, angle, middle_of(d), d.std())
        return [a / b]

    if pairs.where("part > 0").isEmpty():
        return run(["sdf"], whole, "sdf double")

    def marked(own, d, angle):
        d, step = np.sort(d), -(-len(d) // MARKS)
        at = np.append(np.arange(0, len(d) - 1, step), len(d) - 1)
        return len(d), d.mean(), ((d - d.mean()) ** 2).sum(), at, d[at]

    def between(own, d, angle):
        low, high = own[6:8]
        return int((d < low).sum()), np.sort(d[(d >= low) & (d <= high)])

    def with_numbers(found, names):
        """The blocks again, sources with ``names`` of ``found``."""
        made.placed = stored(made.placed.join(found.select("model_id", F.col("src").alias("point_id"), *names), ["model_id", "point_id"], "left"), "blocks")
        made.more, made.kinds = (*more, *names), dict(made.placed.dtypes)

    def limits(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(2).to_pylist():
                n = sum(x["n"] for x in parts)
                mean = sum(x["n"] * x["mean"] for x in parts) / n
                deviation = math.sqrt(sum(x["m2"] + x["n"] * (x["mean"] - mean) ** 2 for x in parts) / n)
                values, fewer, least = np.unique(np.concatenate([x["marks"] for x in parts])), 0, 0
                for x in parts:
                    places, marks = np.array(x["places"]), np.array(x["marks"])
                    fewer = fewer + np.append(places, x["n"])[np.searchsorted(marks, values, "left")]
                    least = least + np.append(0, places + 1)[np.searchsorted(marks, values, "right")]
                # At most so many are below a value, and at least so many not above it.
                rows.append((n, deviation, values[np.flatnonzero(fewer <= (n - 1) // 2)[-1]], values[np.flatnonzero(least >= n // 2 + 1)[0]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]] if rows else [*batch.columns[:2], pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3], ["model_id", "src", "n", "deviation", "low", "high"])

    keys = f"model_id {made.kinds['model_id']}, src {kind}"
    parts = run(["n", "mean", "m2", "places", "marks"], marked, "n long, mean double, m2 double, places array<long>, marks array<double>")
    parts = parts.groupBy("model_id", "src").agg(F.collect_list(F.struct("n", "mean", "m2", "places", "marks")).alias("parts"))
    limit = stored(parts.mapInArrow(limits, f"{keys}, n long, deviation double, low double, high double"), "limits")
    placed = made.placed
    with_numbers(limit, ["low", "high"])
    inside = run(["below", "inside"], between, "below long, inside array<double>").groupBy("model_id", "src").agg(F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("inside"))).alias("inside"))
    at = lambda k: F.get("inside", (k - F.col("below")).cast("int"))
    middle = inside.join(limit, ["model_id", "src"]).select("model_id", "src", ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), "deviation")
    middle = stored(middle, "medians")
    made.placed = placed
    with_numbers(middle, ["median", "deviation"])
    sums = run(["a", "b"], lambda own, d, angle: near(d, angle, *own[6:8]), "a double, b double")
    return sums.groupBy("model_id", "src").agg((F.sum("a") / F.sum("b")).alias("sdf"))
