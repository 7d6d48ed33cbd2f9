"""Meshes: shape diameters by rays through a grid, half-edges, validity and smoothing over edges.

Facets are dealt into blocks of like size.  Rays of a block can only meet facets of blocks that
some cone of the block may hold (``cones``); those are a work item's mesh, in parts where they
are many.  In it, rays walk through a uniform grid, all at once, and meet only the facets of
the cells they cross, so work follows the cells on their way and not the facets there are.
Where large facets cross each other, rays meet the facets whose planes are near their start,
and farther ones only if they hit none of these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, cones
from .spatial import components, stored

#: Facets of a block (by default as many as ``blocks`` says), facets that a work item meets, at most about; facets whose rays are shot together.
LEAF, MET, ASKED = None, 1 << 18, 256
#: Starts and facets whose distances are one matrix product, and facets of the nearest planes wanted at first.
TILE, NEAREST = (64, 8192), 64
#: Rays times facets of one matrix product.
STEP = 1 << 20
#: Grid cells that facets may take up, on average; what a ray and a facet tested as a pair cost more than in a matrix product.
SPREAD, PAIRED = 16, 8
CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]


class RayGrid:
    """Facets (corners: facet, corner, axis) by the cells of a cubic grid that their boxes touch."""

    def __init__(self, corners: np.ndarray):
        self.a, e1, e2 = corners[:, 0], corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
        self.e1, self.e2, self.cross = e1, e2, np.cross(e2, e1)
        low, high = corners.min(axis=1), corners.max(axis=1)
        self.low_of, self.high_of = low, high
        self.low = low.min(axis=0)
        span = max(float((high.max(axis=0) - self.low).max()), 1e-300)
        many = max(int(np.sqrt(len(corners))), 1)
        while True:
            self.step = span * (1 + 1e-9) / many
            thin = 1e-9 * span
            first, last = (np.clip(np.floor((x - self.low) / self.step).astype(np.int64), 0, many - 1) for x in (low - thin, high + thin))
            size = (last - first + 1).prod(axis=1)
            if many == 1 or size.sum() <= SPREAD * len(corners):
                break
            many = max(many * 3 // 4, 1)
        self.many = many
        facet = np.repeat(np.arange(len(corners)), size)
        k = np.arange(len(facet)) - np.repeat(np.cumsum(size) - size, size)
        wide = (last - first + 1)[facet]
        at = first[facet] + np.column_stack((k // (wide[:, 1] * wide[:, 2]), k // wide[:, 2] % wide[:, 1], k % wide[:, 2]))
        cell = (at[:, 0] * many + at[:, 1]) * many + at[:, 2]
        order = np.argsort(cell, kind="stable")
        self.facets, self.cells = facet[order], cell[order]
        self.tests = 0
        # Facets that a ray would meet, about: in large facets that cross each other cells tell little apart.
        self.crowded = PAIRED * 1.5 * len(facet) / many**2 > len(corners)

    def of_all(self, start: np.ndarray, ways: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Distance along rays from one place to the first of ``some`` facets, by matrix products."""
        step = max(STEP // max(len(ways), 1), 1)
        if len(some) > step:
            return np.minimum.reduce([self.of_all(start, ways, some[k : k + step]) for k in range(0, len(some), step)])
        self.tests += len(some) * len(ways)
        a, e1, e2 = self.a[some], self.e1[some], self.e2[some]
        s = start - a
        det, q = ways @ self.cross[some].T, np.cross(s, e1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y, t = ways @ np.cross(e2, s).T / det, ways @ q.T / det, (q * e2).sum(axis=1) / det
            hit = (np.abs(det) > 1e-12) & (x >= 0) & (y >= 0) & (x + y <= 1) & (t > 1e-9)
        return np.where(hit, t, np.inf).min(axis=1, initial=np.inf)

    def planes(self) -> np.ndarray:
        """A column a facet: its plane's unit normal and offset; zero without area, so that it is near everything."""
        normal = self.cross / np.maximum(np.linalg.norm(self.cross, axis=1), 1e-300)[:, None]
        return np.ascontiguousarray(np.column_stack((normal, -(normal * self.a).sum(axis=1))).T)

    def nearest_of_all(self, starts: np.ndarray, ways: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """``nearest`` for rays (starts, rays, 3) from each start: first facets whose planes and boxes are within a reach, farther ones for rays without a hit so near.

        What is hit within the reach is the first, as all facets that near were met.
        """
        planes, low, high = self.planes(), self.low_of, self.high_of
        out = np.full(ways.shape[:2], np.inf)
        span = float(np.abs(np.concatenate((low, high, starts))).max())
        thin = 1e-9 * span + 1e-300
        # A first guess of the reach, from some starts; results do not depend on it.
        few = starts[:: max(len(starts) // 4, 1)]
        most = min(NEAREST, planes.shape[1]) - 1
        guess = float(np.median(np.partition(np.abs(few @ planes[:3] + planes[3]), most, axis=1)[:, most])) if len(few) else 0.0
        for first in range(0, len(starts), TILE[0]):
            left, reach = np.arange(first, min(first + TILE[0], len(starts))), max(4 * guess, thin)
            while len(left):
                if reach >= 2 * span:
                    for n in left:
                        rays = np.flatnonzero(np.isinf(out[n]))
                        out[n, rays] = self.of_all(starts[n], ways[n, rays], np.flatnonzero(np.arange(planes.shape[1]) != skip[n]))
                    break
                near = [[] for _ in left]
                for c in range(0, planes.shape[1], TILE[1]):
                    some = planes[:, c : c + TILE[1]]
                    i, j = np.nonzero(np.abs(starts[left] @ some[:3] + some[3]) <= reach + thin)
                    j += c
                    gap = np.maximum(np.maximum(low[j] - starts[left[i]], starts[left[i]] - high[j]), 0)
                    kept = (gap * gap).sum(axis=1) <= (reach + thin) ** 2
                    i, j = i[kept], j[kept]
                    for k, own in enumerate(np.split(j, np.searchsorted(i, np.arange(1, len(left))))):
                        near[k].append(own)
                again = []
                for k, n in enumerate(left):
                    some = np.concatenate(near[k])
                    rays = np.flatnonzero(np.isinf(out[n]))
                    d = self.of_all(starts[n], ways[n, rays], some[some != skip[n]])
                    out[n, rays] = np.where(d <= reach, d, np.inf)
                    if np.isinf(out[n]).any():
                        again.append(n)
                left, reach = np.array(again, np.int64), reach * 4
        return out

    def nearest(self, start: np.ndarray, way: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Distance along each ray to the first facet but ``skip``; infinite without one."""
        best, live = np.full(len(start), np.inf), np.arange(len(start))
        at = np.floor((start - self.low) / self.step).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Where the grid begins for rays that start outside it.
            t0, t1 = (self.low - start) / way, (self.low + self.many * self.step - start) / way
            enter = np.nan_to_num(np.minimum(t0, t1), nan=-np.inf).max(axis=1).clip(0)
            outside = ((at < 0) | (at >= self.many)).any(axis=1)
            leave = np.nan_to_num(np.maximum(t0, t1), nan=np.inf).min(axis=1)
            live = live[~outside | (enter <= leave)]
            moved = start + np.where(outside, enter, 0)[:, None] * way
            at = np.clip(np.floor((moved - self.low) / self.step).astype(np.int64), 0, self.many - 1)
            turn = np.where(way > 0, 1, -1)
            border = np.where(way == 0, np.inf, (self.low + (at + (way > 0)) * self.step - start) / way)
            every = np.where(way == 0, np.inf, self.step / np.abs(way))
        while len(live):
            cell = (at[live, 0] * self.many + at[live, 1]) * self.many + at[live, 2]
            first, last = np.searchsorted(self.cells, cell, "left"), np.searchsorted(self.cells, cell, "right")
            many = last - first
            if many.sum():
                ray = np.repeat(live, many)
                facet = self.facets[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
                np.minimum.at(best, ray, self.meets(start[ray], way[ray], facet, skip[ray]))
            axis = border[live].argmin(axis=1)
            out = border[live, axis]
            at[live, axis] += turn[live, axis]
            inside = (at[live, axis] >= 0) & (at[live, axis] < self.many)
            border[live, axis] += every[live, axis]
            # A little is left for a facet on the border that rounding puts behind it.
            live = live[inside & (best[live] > out * (1 - 1e-9))]
        return best

    def meets(self, start, way, facet, skip) -> np.ndarray:
        """Distance of each ray to its facet, infinite if it misses."""
        self.tests += len(facet)
        s, e1, e2 = start - self.a[facet], self.e1[facet], self.e2[facet]
        dot = lambda a, b: np.einsum("ij,ij->i", a, b)
        det, q = dot(way, self.cross[facet]), np.cross(s, e1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y, t = dot(way, np.cross(e2, s)) / det, dot(way, q) / det, dot(q, e2) / det
            hit = (np.abs(det) > 1e-12) & (x >= 0) & (y >= 0) & (x + y <= 1) & (t > 1e-9) & (facet != skip)
        return np.where(hit, t, np.inf)


def cone_of_rays(rays: int, cone: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Angle to the cone's axis and turn around it of each ray, the same for all facets."""
    rng = np.random.default_rng(seed)
    return np.radians(cone / 2) * np.sqrt(rng.random(rays)), 2 * np.pi * rng.random(rays)


def first_hits(own: np.ndarray, skip: np.ndarray, mesh: np.ndarray, rays: int = 100, cone: float = 45.0, seed: int = 0, crowded: bool | None = None):
    """For ``ASKED`` facets ``own`` (corners; their places in ``mesh`` or -1) at a time: where they start and how far each of their rays goes, infinite without a hit.

    Rays lie in a cone around a facet's inward normal.
    """
    grid = RayGrid(mesh) if len(mesh) else None
    angle, turn = cone_of_rays(rays, cone, seed)
    for low in range(0, len(own) if grid else 0, ASKED):
        some = own[low : low + ASKED]
        normal = np.cross(some[:, 1] - some[:, 0], some[:, 2] - some[:, 0])
        w = -normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
        u = np.cross(w, np.eye(3)[np.abs(w).argmin(axis=1)])
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        v = np.cross(w, u)
        ways = np.cos(angle)[None, :, None] * w[:, None] + np.sin(angle)[None, :, None] * (np.cos(turn)[None, :, None] * u[:, None] + np.sin(turn)[None, :, None] * v[:, None])
        live = (w != 0).any(axis=1)
        d = np.full((len(some), rays), np.inf)
        if live.any() and (grid.crowded if crowded is None else crowded):
            d[live] = grid.nearest_of_all(some[live].mean(axis=1), ways[live], skip[low : low + ASKED][live])
        elif live.any():
            start = np.repeat(some[live].mean(axis=1), rays, axis=0)
            d[live] = grid.nearest(start, ways[live].reshape(-1, 3), np.repeat(skip[low : low + ASKED][live], rays)).reshape(-1, rays)
        yield low, d


def averaged(d: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Raw shape diameters from rays' lengths: those within one standard deviation of the median, weighted by one over the angle; nan without a hit."""
    out = np.full(len(d), np.nan)
    for n, far in enumerate(d):
        got = np.isfinite(far)
        if got.any():
            far, at = far[got], np.maximum(angle[got], 1e-6)
            near = np.abs(far - np.median(far)) <= far.std() + 1e-8
            out[n] = (far[near] / at[near]).sum() / (1 / at[near]).sum()
    return out


def shoot(own: np.ndarray, skip: np.ndarray, mesh: np.ndarray, rays: int = 100, cone: float = 45.0, seed: int = 0, crowded: bool | None = None) -> np.ndarray:
    """Raw shape diameter of facets ``own`` (corners; their places in ``mesh`` or -1): nan without a hit."""
    out, (angle, _) = np.full(len(own), np.nan), cone_of_rays(rays, cone, seed)
    for low, d in first_hits(own, skip, mesh, rays, cone, seed, crowded):
        out[low : low + len(d)] = averaged(d, angle)
    return out


def with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """model_id, face_id and the nine numbers x0 ... z2 of each facet's corners."""
    out = faces
    for k in range(3):
        out = out.join(vertices.select("model_id", F.col("vertex_id").alias(f"v{k}"), *[F.col(c).cast("double").alias(f"{c}{k}") for c in "xyz"]), ["model_id", f"v{k}"])
    return out.select("model_id", "face_id", *CORNERS)


def facet_values(vertices: DataFrame, faces: DataFrame, rays: int = 100, cone: float = 45.0, leaf: int | None = LEAF, asked: int | None = None) -> DataFrame:
    """model_id, face_id and the raw value of each facet, null where no ray meets another facet.

    ``leaf``: facets of a block; ``asked``: facets that a work item meets, at most about.
    """
    facets = with_corners(vertices, faces)
    e1, e2 = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    cross = [e1[i] * e2[j] - e1[j] * e2[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    middle = {c: (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3 for c in "xyz"}
    items = cones.unit_normals(stored(facets.withColumns(middle | {f"n{c}": x for c, x in zip("xyz", cross, strict=True)}), "facets"))
    items = items.withColumnRenamed("face_id", "point_id").withColumn("apart", cones.by_side())
    made = blocks.Blocks(items, ("ux", "uy", "uz", *CORNERS), leaf, apart="apart")
    box = [agg(pick(*[f"{c}{k}" for k in range(3)])).alias(f"to_{end}_{c}") for c in "xyz" for end, agg, pick in (("low", F.min, F.least), ("high", F.max, F.greatest))]
    turn = [agg(c).alias(f"{end}_{c}") for c in ("ux", "uy", "uz") for end, agg in (("low", F.min), ("high", F.max))]
    bounds = made.boxes.join(made.placed.groupBy("model_id", "block").agg(*box, *turn), ["model_id", "block"])
    pairs = cones.block_pairs(made, bounds, cone / 2, False, asked or MET)
    kind, angle = made.kinds["point_id"], cone_of_rays(rays, cone)[0]

    def run(one):
        def work(own, other, middle, block):
            ids, asked_ids = (x[0].to_numpy(zero_copy_only=False) for x in (other, own))
            order = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids, asked_ids, sorter=order), len(ids) - 1)
            skip = np.where(ids[order[at]] == asked_ids, order[at], -1)
            corners, mesh = (x[1][:, 6:].reshape(-1, 3, 3) for x in (own, other))
            for low, d in first_hits(corners, skip, mesh, rays, cone):
                yield [own[0].slice(low, len(d)), averaged(d, angle) if one else list(d)]

        return made.each(pairs, work, f"face_id {kind}, {'value double' if one else 'd array<double>'}")

    if pairs.where("part > 0").isEmpty():
        found = run(True)
    else:
        # Of each ray the shortest of all parts.
        shortest = run(False).groupBy("model_id", "face_id").agg(F.array(*[F.min(F.get("d", F.lit(k))) for k in range(rays)]).alias("d"))

        def join(batches):
            import pyarrow as pa

            for batch in batches:
                d = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(averaged(d, angle))], ["model_id", "face_id", "value"])

        found = shortest.mapInArrow(join, f"model_id {made.kinds['model_id']}, face_id {kind}, value double")
    found = found.select("model_id", "face_id", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return faces.select("model_id", "face_id").join(found, ["model_id", "face_id"], "left")


def half_edges(faces: DataFrame) -> DataFrame:
    """model_id, face_id, k, a, b: each facet's three directed edges, k counts from its first vertex."""
    ends = [F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("a"), F.col(f"v{(k + 1) % 3}").alias("b")) for k in range(3)]
    return faces.select("model_id", "face_id", F.explode(F.array(*ends)).alias("e")).select("model_id", "face_id", "e.k", "e.a", "e.b")


def neighbors(faces: DataFrame) -> DataFrame:
    """model_id, face_id, near: other facets with a common edge, whichever way it runs."""
    edge = half_edges(faces).select("model_id", "face_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct()
    both = edge.join(edge.withColumnRenamed("face_id", "near"), ["model_id", "low", "high"]).where("face_id <> near")
    return both.select("model_id", "face_id", "near").distinct()


PROBLEMS = ("no facets", "vertex missing", "vertex twice in a facet", "edge twice in one direction", "facets around a vertex apart")


def problems(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """model_id, problem, n: what makes a mesh no oriented surface (with or without border), and how often; nothing for a valid one.

    Models are those of either table.  Facets around a vertex are apart if edges between them
    do not join them all.
    """
    models = vertices.select("model_id").union(faces.select("model_id")).distinct()
    named = lambda df, k: df.groupBy("model_id").agg(F.count("*").alias("n")).select("model_id", F.lit(PROBLEMS[k]).alias("problem"), "n")
    none = models.join(faces.select("model_id").distinct(), "model_id", "left_anti")
    edges = stored(half_edges(faces).withColumn("id", F.monotonically_increasing_id()), "edges")
    known = vertices.select("model_id", F.col("vertex_id").alias("a"))
    missing = edges.select("model_id", "a").distinct().join(known, ["model_id", "a"], "left_anti")
    flat = faces.where("v0 = v1 OR v1 = v2 OR v2 = v0")
    twice = edges.where("a <> b").groupBy("model_id", "a", "b").count().where("count > 1")
    # The corner at a of an edge a -> b and the corner at a of the facet behind it, which has b -> a: its next edge starts there.
    after = edges.select("model_id", "face_id", F.pmod(F.col("k") - 1, F.lit(3)).alias("k"), F.col("id").alias("next"))
    twin = edges.join(after, ["model_id", "face_id", "k"]).select("model_id", F.col("b").alias("a"), F.col("a").alias("b"), "next")
    around = edges.join(twin, ["model_id", "a", "b"]).select(F.col("id").alias("src"), F.col("next").alias("dst"))
    fans = edges.join(components(edges.select("id"), around), "id")
    apart = fans.groupBy("model_id", "a").agg(F.count_distinct("component").alias("fans")).where("fans > 1")
    out = none.select("model_id", F.lit(PROBLEMS[0]).alias("problem"), F.lit(1).cast("long").alias("n"))
    for k, df in enumerate((missing, flat, twice, apart), 1):
        out = out.unionByName(named(df, k))
    return out


def window(count):
    """Edges between a facet and the farthest that smooths it, for a mesh of ``count`` facets."""
    return F.floor(F.sqrt(count / F.lit(2000.0))) + 1


def filled(values: DataFrame, near: DataFrame) -> DataFrame:
    """Facets without a value take the mean of their neighbours', else the model's least; without any, 0."""
    other = values.where("value IS NOT NULL").select("model_id", F.col("face_id").alias("near"), F.col("value").alias("v"))
    means = values.where("value IS NULL").select("model_id", "face_id").join(near, ["model_id", "face_id"]).join(other, ["model_id", "near"]).groupBy("model_id", "face_id").agg(F.avg("v").alias("mean"))
    least = values.groupBy("model_id").agg(F.min("value").alias("least"))
    out = values.join(means, ["model_id", "face_id"], "left").join(least, "model_id")
    return out.select("model_id", "face_id", F.coalesce("value", "mean", "least", F.lit(0.0)).alias("value"))


def smoothed(values: DataFrame, near: DataFrame) -> DataFrame:
    """Values averaged over facets a few edges away, less over farther ones and over other values.

    Gaussian weights: of the edges between, with half the window as deviation, and of the
    difference, with 1.5 times the root mean square of all differences in the window.
    """
    counts = values.groupBy("model_id").agg(F.count("*").alias("n")).select("model_id", window(F.col("n")).cast("int").alias("window"))
    widest = counts.agg(F.coalesce(F.max("window"), F.lit(0))).collect()[0][0]
    reach = values.join(counts, "model_id").select("model_id", "face_id", F.col("face_id").alias("near"), F.lit(0).alias("edges"), "window")
    last = reach
    step = near.select("model_id", F.col("face_id").alias("near"), F.col("near").alias("further"))
    for k in range(1, widest + 1):
        next_ = last.where(F.col("window") >= k).join(step, ["model_id", "near"]).select("model_id", "face_id", F.col("further").alias("near"), F.lit(k).alias("edges"), "window").distinct()
        last = next_.join(reach.select("model_id", "face_id", "near"), ["model_id", "face_id", "near"], "left_anti")
        if widest > 1:
            last = stored(last, "ring")
        reach = reach.unionByName(last)
    own = values.select("model_id", "face_id", F.col("value").alias("own"))
    other = values.select("model_id", F.col("face_id").alias("near"), F.col("value").alias("other"))
    seen = reach.join(own, ["model_id", "face_id"]).join(other, ["model_id", "near"]).withColumn("off", F.col("other") - F.col("own"))
    wide = seen.groupBy("model_id", "face_id").agg(F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("deviation"))
    bell = lambda x, deviation: F.coalesce(F.exp(-0.5 * (x / F.nullif(deviation, F.lit(0.0))) ** 2), F.lit(1.0))
    weight = bell(F.col("edges"), F.col("window") / 2.0) * bell(F.col("off"), 1.5 * F.col("deviation"))
    return seen.join(wide, ["model_id", "face_id"]).withColumn("w", weight).groupBy("model_id", "face_id").agg((F.sum(F.col("other") * F.col("w")) / F.sum("w")).alias("value"))


def scaled(values: DataFrame) -> DataFrame:
    """Values of each model scaled to [0, 1]."""
    span = values.groupBy("model_id").agg(F.min("value").alias("low"), (F.max("value") - F.min("value")).alias("spread"))
    return values.join(span, "model_id").select("model_id", "face_id", F.coalesce((F.col("value") - F.col("low")) / F.nullif("spread", F.lit(0.0)), F.lit(0.0)).alias("value"))


def mesh_sdf(vertices: DataFrame, faces: DataFrame, rays: int = 100, cone: float = 45.0) -> DataFrame:
    """model_id, vertex_id, sdf: mean of the incident facets' values, null without facets.

    Facets' raw values are filled, smoothed over edges and scaled to [0, 1] a model.
    """
    from .solids import vertex_means

    near = stored(neighbors(faces), "near")
    raw = stored(facet_values(vertices, faces, rays, cone), "raw")
    values = stored(smoothed(stored(filled(raw, near), "filled"), near), "smoothed")
    means = vertex_means(faces, scaled(values)).withColumnRenamed("value", "sdf")
    return vertices.select("model_id", "vertex_id").join(means, ["model_id", "vertex_id"], "left")
