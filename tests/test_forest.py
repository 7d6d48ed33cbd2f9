"""The distributed spanning forest and orientation against a tree grown point by point."""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.operators import forest, solids, spatial

POINT = "model_id long, point_id long, x double, y double, z double, nx double, ny double, nz double"


def grown(ids, edges, top):
    """(root, parity) of each node of a forest grown from the nodes in order ``top``, cheapest link first."""
    near = {i: [] for i in ids}
    for a, b, cost, flip in edges:
        near[a].append((cost, min(a, b), max(a, b), b, flip))
        near[b].append((cost, min(a, b), max(a, b), a, flip))
    seen = {}
    for start in top:
        if start in seen:
            continue
        heap = [((), start, start, False)]
        while heap:
            _, i, parent, flip = heapq.heappop(heap)
            if i in seen:
                continue
            seen[i] = (start, flip)
            for cost, lo, hi, j, f in near[i]:
                if j not in seen:
                    heapq.heappush(heap, ((cost, lo, hi), j, i, flip != f))
    return seen


def test_forest_equals_one_grown_point_by_point(spark):
    rng = np.random.default_rng(1)
    links, nodes, want = [], [], {}
    for m, (n, e) in enumerate(((1, 0), (2, 1), (60, 150), (200, 190), (300, 900))):
        ids = rng.permutation(10 * n)[:n].tolist()
        edges = [(int(rng.choice(ids)), int(rng.choice(ids)), float(rng.integers(0, 40)), bool(rng.integers(0, 2))) for _ in range(e)]
        edges = list({(min(a, b), max(a, b)): (a, b, c, f) for a, b, c, f in edges if a != b}.values())
        nodes += [(m, i) for i in ids]
        links += [(m, *x) for x in edges] + [(m, b, a, c, f) for a, b, c, f in edges[::3]] + [(m, ids[0], ids[0], 0.0, True)]
        want[m] = grown(ids, edges, sorted(ids))
    points = spark.createDataFrame(nodes, "model_id long, point_id long")
    found = forest.spanning_forest(points, spark.createDataFrame(links, "model_id long, a long, b long, cost double, flip boolean")).collect()
    assert len(found) == len(nodes)
    for m, own in want.items():
        got = {r.point_id: (r.root, r.flip) for r in found if r.model_id == m}
        for i, (root, flip) in own.items():
            assert got[i][0] == got[root][0] and (got[i][1] != got[root][1]) == flip
        assert len({r for r, _ in got.values()}) == len({r for r, _ in own.values()})


def test_orientation_equals_the_grown_tree(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(2):
        p = rng.normal(size=(120, 3))
        p /= np.linalg.norm(p, axis=1)[:, None]
        n = p + 0.1 * rng.normal(size=p.shape)
        n *= rng.choice([-1, 1], size=len(p))[:, None]
        p[100:] += 9  # a part of its own
        rows += [(m, i, *map(float, p[i]), *map(float, n[i])) for i in range(len(p))]
    points = spark.createDataFrame(rows, POINT)
    near = spatial.knn(points, 8, 0.3).toPandas()
    got = solids.orient_normals(points, 8, 0.3).toPandas()
    for m, own in pd.DataFrame(rows, columns=["m", "i", *"xyz", "nx", "ny", "nz"]).groupby("m"):
        normal = own[["nx", "ny", "nz"]].to_numpy()
        edges = [(int(r.src), int(r.dst), 1 - abs(float(normal[r.src] @ normal[r.dst])), bool(normal[r.src] @ normal[r.dst] < 0)) for r in near[near.model_id == m].itertuples()]
        tree = grown(own.i.tolist(), edges, own.sort_values(["z", "i"], ascending=[False, True]).i.tolist())
        sign = [(-1 if flip else 1) * (1 if normal[root][2] >= 0 else -1) for root, flip in (tree[i] for i in range(len(own)))]
        mine = got[got.model_id == m].sort_values("point_id")[["nx", "ny", "nz"]].to_numpy()
        np.testing.assert_allclose(mine, normal * np.array(sign)[:, None])


def test_no_links_and_no_points(spark):
    one = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0)], POINT)
    assert [r.nz for r in solids.orient_normals(one).collect()] == [1.0]
    assert solids.orient_normals(one.where("false")).count() == 0
    assert forest.spanning_forest(one, one.select("model_id", F.col("point_id").alias("a"), F.col("point_id").alias("b"), F.col("x").alias("cost"), F.lit(True).alias("flip"))).count() == 1
