"""Whole-model geometry: enclosing ball, normalisation, normals; values of vertices from facets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def ball(points: np.ndarray, eps: float = 1e-14, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Smallest enclosing ball: active sets of support points, farthest violator first."""
    points = np.unique(points, axis=0)
    support = [int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))]
    center, radius2 = points[support[0]].astype(float), 0.0
    for _ in range(rounds):
        d2 = ((points - center) ** 2).sum(axis=1)
        far = int(np.argmax(d2))
        if d2[far] <= radius2 * (1 + 1e-12) + eps:
            break
        support, center, radius2 = _basis(points, [*support, far])
    return center, float(np.sqrt(radius2))


def _basis(points, chosen):
    """The subset of at most five points whose circumball, the smallest, holds them all."""
    from itertools import combinations

    best = None
    for k in range(1, min(4, len(chosen)) + 1):
        for own in combinations(chosen, k):
            p = points[list(own)]
            edges = p[1:] - p[0]
            if k > 1 and np.linalg.matrix_rank(edges, tol=1e-12) < k - 1:
                continue
            center = p[0] + (np.linalg.lstsq(2 * edges, (edges**2).sum(axis=1), rcond=None)[0] if k > 1 else 0)
            r2 = float(((p[0] - center) ** 2).sum())
            if (((points[chosen] - center) ** 2).sum(axis=1) <= r2 * (1 + 1e-10) + 1e-14).all() and (best is None or r2 < best[2]):
                best = (list(own), center, r2)
    return best


def balls(points: DataFrame) -> DataFrame:
    """Per model: center_x, center_y, center_z, radius.

    Each task first keeps the points farthest in 64 directions and those outside their
    ball, so a model's group holds few rows; then all points are tested and violators added.
    """
    kinds = dict(points.dtypes)
    schema = f"model_id {kinds['model_id']}, cx double, cy double, cz double, radius double"

    def fit(pdf):
        import pandas as pd

        center, radius = ball(pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame([(pdf.model_id.iloc[0], *center, radius)], columns=["model_id", "cx", "cy", "cz", "radius"])

    rng = np.random.default_rng(0)
    ways = rng.normal(size=(64, 3))
    far = [F.max_by(F.struct("x", "y", "z"), F.col("x") * float(a) + F.col("y") * float(b) + F.col("z") * float(c)) for a, b, c in ways]
    basis = points.groupBy("model_id").agg(F.array(*far).alias("p")).select("model_id", F.explode("p").alias("p")).select("model_id", "p.x", "p.y", "p.z").distinct()
    while True:
        basis = _fixed(basis)
        found = basis.groupBy("model_id").applyInPandas(fit, schema)
        d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
        out = points.select("model_id", "x", "y", "z").join(found, "model_id").where(d2 > F.col("radius") ** 2 * (1 + 1e-10) + 1e-14)
        worst = _fixed(out.groupBy("model_id").agg(F.max_by(F.struct("x", "y", "z"), d2).alias("p")).select("model_id", "p.x", "p.y", "p.z"))
        if worst.isEmpty():
            return found
        basis = basis.unionByName(worst).distinct()


def _fixed(df: DataFrame) -> DataFrame:
    from .spatial import checkpointed

    return checkpointed(df.sparkSession, df)


def normalize(points: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Points moved and scaled into the unit ball, normals to unit length."""
    found = balls(points) if found is None else found
    joined = points.join(found, "model_id")
    radius = F.nullif("radius", F.lit(0.0))
    out = {c: (F.col(c) - F.col(f"c{c}")) / radius for c in "xyz"}
    if "nx" in points.columns:
        n = [F.col(c) for c in ("nx", "ny", "nz")]
        size = F.nullif(F.sqrt(G.dot(n, n)), F.lit(0.0))
        out |= {c: F.col(c) / size for c in ("nx", "ny", "nz")}
    return joined.withColumns(out).select(*points.columns)


def fit_normals(sets: np.ndarray, degree: int = 2) -> np.ndarray:
    """Normals at the first points of neighbourhoods (n, size, 3): PCA planes, then quadratic height fields over them."""
    many, size = sets.shape[:2]
    if size < 3:
        return np.tile([0.0, 0.0, 1.0], (many, 1))
    centered = sets - sets.mean(axis=1, keepdims=True)
    frame = np.linalg.eigh(centered.transpose(0, 2, 1) @ centered / (size - 1))[1][:, :, ::-1]  # columns: two tangents, then the normal
    u, v, h = ((sets - sets[:, :1]) @ frame).transpose(2, 0, 1)
    slope = np.zeros((many, 2))
    if degree >= 2 and size >= 6:
        terms = np.stack((np.ones_like(u), u, v, u * u, u * v, v * v), axis=2)
        slope = (np.linalg.pinv(terms, rcond=np.finfo(float).eps * max(size, 6)) @ h[:, :, None])[:, 1:3, 0]
    normal = frame[:, :, 2] - slope[:, :1] * frame[:, :, 0] - slope[:, 1:] * frame[:, :, 1]
    return normal / np.linalg.norm(normal, axis=1, keepdims=True)


def jet_normals(points: DataFrame, k: int = 18, radius: float = 0.2) -> DataFrame:
    """Per point a normal from its k nearest; largest component positive until oriented.

    A batch's neighbourhoods of one size are solved together.
    """
    from .spatial import knn

    links = knn(points, k, radius).select("model_id", "src", "dst", "rank")
    links = links.unionByName(points.select("model_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(0).alias("rank")))
    place = points.select("model_id", F.col("point_id").alias("dst"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    near = F.sort_array(F.collect_list(F.struct("rank", "x", "y", "z")))
    sets = links.join(place, ["model_id", "dst"]).groupBy("model_id", "src").agg(near.alias("near"))
    sets = sets.select("model_id", F.col("src").alias("point_id"), F.flatten(F.transform("near", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("near"))
    kinds = dict(points.dtypes)

    def run(batches):
        for batch in batches:
            near = batch.column(2)
            size, flat = near.value_lengths().to_numpy() // 3, near.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(3 * size)))[:-1]
            out = np.empty((len(size), 3))
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                out[own] = fit_normals(flat[start[own][:, None] + np.arange(3 * n)].reshape(-1, n, 3))
            out *= np.sign(np.take_along_axis(out, np.abs(out).argmax(axis=1)[:, None], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(out[:, i]) for i in range(3)]], ["model_id", "point_id", "nx", "ny", "nz"])

    return sets.mapInArrow(run, f"model_id {kinds['model_id']}, point_id {kinds['point_id']}, nx double, ny double, nz double")


def radius_normals(points: DataFrame, radius: float = 0.1) -> DataFrame:
    """Per point the normal of the plane through all within ``radius``, largest component positive."""
    from .spatial import moments

    flat = moments(points, radius, centered=True)
    found = G.with_eigen(flat, {"v": [F.col(c) for c in G.SIX]}, ("v",))
    return found.select("model_id", F.col("src").alias("point_id"), *[F.get("v_e3", F.lit(i)).alias(f"n{c}") for i, c in enumerate("xyz")])


def orient_normals(points: DataFrame, k: int = 16, radius: float = 0.2) -> DataFrame:
    """Normals flipped along a minimum spanning forest of the neighbour graph, the top point of each tree upward.

    A link costs one less the cosine between both normals' lines; its ends' normals agree.
    """
    from .forest import spanning_forest
    from .spatial import knn, stored

    points = stored(points, "points")
    normal = lambda c, name: points.select("model_id", F.col("point_id").alias(c), F.array("nx", "ny", "nz").alias(name))
    links = knn(points, k, radius).select("model_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    links = links.join(normal("a", "n1"), ["model_id", "a"]).join(normal("b", "n2"), ["model_id", "b"])
    cosine = F.aggregate(F.zip_with("n1", "n2", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    links = links.select("model_id", "a", "b", (1 - F.abs(cosine)).alias("cost"), (cosine < 0).alias("flip"))
    found = spanning_forest(points, links)
    top = F.min(F.struct((-F.col("z")).alias("depth"), "point_id", (F.col("nz") < 0).alias("down"), "flip")).alias("top")
    tops = found.join(points.select("model_id", "point_id", "z", "nz"), ["model_id", "point_id"]).groupBy("model_id", "root").agg(top)
    turned = found.join(tops, ["model_id", "root"]).select("model_id", "point_id", ((F.col("flip") != F.col("top.flip")) != F.col("top.down")).alias("turned"))
    out = points.join(turned, ["model_id", "point_id"])
    return out.withColumns({c: F.when(F.col("turned"), -F.col(c)).otherwise(F.col(c)) for c in ("nx", "ny", "nz")}).select(*points.columns)


def vertex_labels(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Each vertex takes the label of the last of its faces."""
    corners = faces.join(labels, ["model_id", "face_id"]).select("model_id", "face_id", "label", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return corners.groupBy("model_id", "vertex_id").agg(F.max_by("label", "face_id").alias("label"))


def vertex_means(faces: DataFrame, values: DataFrame) -> DataFrame:
    """Each vertex takes the mean value of its faces."""
    corners = faces.join(values, ["model_id", "face_id"]).select("model_id", "value", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return corners.groupBy("model_id", "vertex_id").agg(F.avg("value").alias("value"))
