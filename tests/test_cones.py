"""Cone search by pruned cells against all pairs."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cones, spatial

COLUMNS = ["model_id", "point_id", "x", "y", "z", "nx", "ny", "nz"]


def by_all_pairs(p, cone=30.0):
    """Shape diameters of one model's points (x, y, z, nx, ny, nz), every pair tried."""
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = p[:, 3:] / np.linalg.norm(p[:, 3:], axis=1)[:, None]
        for i in range(len(p)):
            v = p[:, :3] - p[i, :3]
            d = np.sqrt((v * v).sum(axis=1))
            angle = np.degrees(np.arccos(np.clip(-(v @ unit[i]) / d, -1, 1)))
            hit = (angle > 0) & (angle <= cone) & (p[:, 3:] @ p[i, 3:] <= 0) & (np.arange(len(p)) != i)
            d, angle = d[hit], angle[hit]
            near = np.abs(d - np.median(d)) <= d.std() + 1e-8 if len(d) else np.zeros(0, bool)
            out.append((d[near] / angle[near]).sum() / (1 / angle[near]).sum() if near.any() else 0.0)
    return np.array(out)


def slab(rng, n, thick=0.1):
    """Points on two parallel unit squares, normals outward and slightly turned."""
    top = np.arange(n) % 2
    turned = rng.normal(scale=0.05, size=(n, 3)) + np.column_stack((np.zeros((n, 2)), 2.0 * top - 1))
    return np.column_stack((rng.random((n, 2)), thick * top, turned))


def frame(spark, models):
    parts = [pd.DataFrame(np.column_stack((np.full(len(p), m), np.arange(len(p)), p)), columns=COLUMNS) for m, p in models.items()]
    return spark.createDataFrame(pd.concat(parts)).withColumns({c: F.col(c).cast("long") for c in COLUMNS[:2]})


@pytest.mark.parametrize("leaf, all_pairs", [(1, 0), (16, 0), (32, 1000)])
def test_shape_diameters_equal_all_pairs(spark, leaf, all_pairs):
    rng = np.random.default_rng(1)
    ball = rng.normal(size=(300, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    odd = rng.normal(size=(40, 6))
    odd[5, 3:] = 0  # no direction
    odd[6:9, :3] = odd[6, :3]  # coincident points
    models = {1: np.column_stack((ball, ball)), 2: slab(rng, 400), 3: rng.normal(size=(250, 6)), 4: odd, 5: rng.normal(size=(1, 6)), 6: np.tile(rng.normal(size=6), (7, 1))}
    got = spatial.point_sdf(frame(spark, models), leaf=leaf, all_pairs=all_pairs).toPandas()
    assert len(got) == sum(map(len, models.values()))
    for m, p in models.items():
        own = got[got.model_id == m].sort_values("point_id").sdf.to_numpy()
        np.testing.assert_allclose(own, by_all_pairs(p), atol=1e-9)


def test_pairs_tested_stay_few_in_a_large_cloud(spark):
    n = 100_000
    placed = cones.placed(cones.unit_normals(frame(spark, {1: slab(np.random.default_rng(2), n)})))
    pairs = cones.cell_pairs(cones.cells(placed), None, 30.0, facing=True)
    tested = pairs.agg(F.sum(F.col("s_n") * F.col("t_n"))).collect()[0][0]
    assert 0 < tested < 0.05 * n * n
    assert pairs.count() < n * 10


def test_points_without_place_or_direction_are_zero(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 2, 0.0, 0.0, -1.0, 0.0, 0.0, -1.0), (1, 3, None, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 4, 0.0, 0.1, -1.0, None, 0.0, 1.0), (1, 5, float("nan"), 0.0, 0.0, 0.0, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "model_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    # Straight below is at angle 0, which does not count.
    for all_pairs in (0, 10):
        assert {r.point_id: r.sdf for r in spatial.point_sdf(points, all_pairs=all_pairs).collect()} == {i: 0.0 for i in range(1, 6)}
        assert spatial.point_sdf(points.where("false"), all_pairs=all_pairs).count() == 0


@pytest.mark.parametrize("met", [1 << 20, 300])
def test_large_models_are_met_in_blocks_and_parts(spark, monkeypatch, met):
    """Hits are never rows: blocks are compared inside tasks, in parts where a block meets many points."""
    monkeypatch.setattr(cones, "MET", met)
    rng = np.random.default_rng(6)
    odd = rng.normal(size=(700, 6))
    odd[:5, 3:] = 0
    odd[5:9, :3] = odd[5, :3]
    odd[9, :3] = 1e5  # far away
    models = {1: rng.normal(size=(1500, 6)), 2: slab(rng, 900), 3: odd}
    found = spatial.point_sdf(frame(spark, models), all_pairs=0)
    got = found.toPandas()
    for m, p in models.items():
        own = got[got.model_id == m].sort_values("point_id").sdf.to_numpy()
        np.testing.assert_allclose(own, by_all_pairs(p), atol=1e-9)


def test_a_cloud_ten_times_as_large_makes_no_rows_of_hits(spark):
    """Rows of a cloud where cones hold a fifteenth of all: as hits they were millions."""
    n = 6000
    points = np.random.default_rng(7).normal(size=(n, 6))
    given = cones.unit_normals(frame(spark, {1: points}))
    found = cones.diameters(given, 30.0)
    assert found.count() <= n
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_no_more_than_one_sources_hits_are_held():
    """Cones of a run of sources hold 640,000 points in all; one with a source's id is none of its hits."""
    q = np.random.default_rng(8).normal(size=(40_000, 6))
    ids = np.arange(len(q))
    ids[1000:1100] = 3
    side = lambda at: cones.by_normal((pa.array(ids[at]), q[at]))
    own, other = side(slice(0, 64)), side(slice(None))
    tracemalloc.start()
    got = {own[0][int(i)].as_py(): len(d) for i, d, _ in cones.each_source(own, other, 89.0, 32)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for i in range(64):
        v = q[:, :3] - q[i, :3]
        with np.errstate(invalid="ignore"):
            angle = np.degrees(np.arccos(-(v @ q[i, 3:]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q[i, 3:]))))
        want[i] = int(((angle <= 89) & (q[:, 3:] @ q[i, 3:] <= 0) & (ids != i)).sum())
    assert got == want and sum(want.values()) > 500_000
    assert most < 30e6
