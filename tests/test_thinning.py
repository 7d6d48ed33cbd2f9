"""Thinning with a least distance, and normals fitted in batches, against plain loops."""

import hashlib

import numpy as np

from pointloom.operators import solids, spatial

POINT = "model_id long, point_id long, x double, y double, z double, note string"


def greedy(points, distance):
    """Ids kept of (id, place), in order of their hashes."""
    kept = []
    for i, p in sorted(points, key=lambda t: (hashlib.md5(str(t[0]).encode()).hexdigest(), t[0])):
        if all(((p - q) ** 2).sum() >= distance * distance for _, q in kept):
            kept.append((i, p))
    return {i for i, _ in kept}


def test_thinning_equals_one_point_after_the_other(spark):
    rng = np.random.default_rng(1)
    models = {0: rng.random((150, 3)), 1: np.round(rng.random((120, 3)), 1), 2: np.zeros((40, 3)), 3: np.column_stack((np.arange(60) * 0.2, np.zeros((60, 2)))), 4: np.ones((1, 3))}
    rows = [(m, i, *map(float, p), "x") for m, own in models.items() for i, p in enumerate(own)]
    points = spark.createDataFrame(rows, POINT)
    got = spatial.thinned(points, 0.25).collect()
    for m, own in models.items():
        assert {r.point_id for r in got if r.model_id == m} == greedy(list(enumerate(own)), 0.25)
    assert {r.note for r in got} == {"x"} and spatial.thinned(points.where("false"), 0.25).count() == 0


def one_normal(xyz):
    """PCA plane, then a quadratic height field over it, by least squares."""
    centered = xyz - xyz.mean(axis=0)
    frame = np.linalg.eigh(centered.T @ centered)[1][:, ::-1].T
    u, v, h = ((xyz - xyz[0]) @ frame.T).T
    slope = np.linalg.lstsq(np.column_stack((np.ones_like(u), u, v, u * u, u * v, v * v)), h, rcond=None)[0][1:3] if len(xyz) >= 6 else np.zeros(2)
    normal = frame[2] - slope[0] * frame[0] - slope[1] * frame[1]
    return normal / np.linalg.norm(normal)


def test_normals_fitted_together_equal_those_fitted_one_by_one():
    rng = np.random.default_rng(2)
    for size in (3, 5, 6, 19):
        sets = rng.normal(size=(50, size, 3)) * (1, 1, 0.1)
        got = solids.fit_normals(sets)
        want = np.array([one_normal(s) for s in sets])
        np.testing.assert_allclose(got * np.sign((got * want).sum(axis=1))[:, None], want, atol=1e-9)
    flat = np.zeros((2, 8, 3))
    flat[:, :, :2] = rng.normal(size=(2, 8, 2))
    np.testing.assert_allclose(np.abs(solids.fit_normals(flat)), [[0, 0, 1]] * 2, atol=1e-12)
    line = np.zeros((1, 8, 3))
    line[0, :, 0] = np.arange(8)
    assert abs(solids.fit_normals(line)[0, 0]) < 1e-9
    assert solids.fit_normals(np.zeros((3, 1, 3))).tolist() == [[0, 0, 1]] * 3
