"""Rays through a grid against all facets, half-edges, validity and smoothing."""

import numpy as np
import pytest

from pointloom.operators import meshes
from pointloom.plans import actions


def by_all_facets(corners, rays=100, cone=45.0, seed=0):
    """Raw shape diameters, every ray against every facet; nan without a hit."""
    a, e1, e2 = corners[:, 0], corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    rng = np.random.default_rng(seed)
    angle = np.radians(cone / 2) * np.sqrt(rng.random(rays))
    turn = 2 * np.pi * rng.random(rays)
    out = np.full(len(corners), np.nan)
    for f in range(len(corners)):
        n = np.cross(e1[f], e2[f])
        if not n.any():
            continue
        w = -n / np.linalg.norm(n)
        u = np.cross(w, np.eye(3)[np.abs(w).argmin()])
        u /= np.linalg.norm(u)
        found = []
        for p, q in zip(angle, turn):
            d = np.cos(p) * w + np.sin(p) * (np.cos(q) * u + np.sin(q) * np.cross(w, u))
            h = np.cross(d, e2)
            det = (e1 * h).sum(axis=1)
            s = corners[f].mean(axis=0) - a
            with np.errstate(divide="ignore", invalid="ignore"):
                x, k = (s * h).sum(axis=1) / det, np.cross(s, e1)
                y, t = k @ d / det, (k * e2).sum(axis=1) / det
                hit = (np.abs(det) > 1e-12) & (x >= 0) & (y >= 0) & (x + y <= 1) & (t > 1e-9)
            hit[f] = False
            if hit.any():
                found.append((t[hit].min(), max(p, 1e-6)))
        if found:
            d, at = np.array(found).T
            near = np.abs(d - np.median(d)) <= d.std() + 1e-8
            out[f] = (d[near] / at[near]).sum() / (1 / at[near]).sum()
    return out


def sphere(n):
    """Corners, vertices and facets of a round mesh of about 2 n n facets, normals outward."""
    lat, lon = np.linspace(0, np.pi, n + 1)[1:-1], np.linspace(0, 2 * np.pi, 2 * n, endpoint=False)
    grid = np.stack([np.outer(np.sin(lat), np.cos(lon)), np.outer(np.sin(lat), np.sin(lon)), np.outer(np.cos(lat), np.ones(2 * n))], axis=-1).reshape(-1, 3)
    v = np.concatenate((grid, [[0, 0, 1], [0, 0, -1]]))
    at = lambda i, j: i * 2 * n + j % (2 * n)
    f = [(len(grid), at(0, j), at(0, j + 1)) for j in range(2 * n)] + [(len(grid) + 1, at(n - 2, j + 1), at(n - 2, j)) for j in range(2 * n)]
    for i in range(n - 2):
        for j in range(2 * n):
            f += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    return v, np.array(f)


def tables(spark, models):
    v = [(m, i, *map(float, p)) for m, (vs, _) in models.items() for i, p in enumerate(vs)]
    f = [(m, i, *map(int, t)) for m, (_, fs) in models.items() for i, t in enumerate(fs)]
    return spark.createDataFrame(v, "model_id int, vertex_id int, x double, y double, z double"), spark.createDataFrame(f, "model_id int, face_id int, v0 int, v1 int, v2 int")


def soup(rng, n, size=0.3):
    v = rng.random((n, 1, 3)) + size * rng.normal(size=(n, 3, 3))
    v[0, 2] = v[0, 1]  # a facet without area
    return v.reshape(-1, 3), np.arange(3 * n).reshape(-1, 3)


def test_rays_through_the_grid_equal_all_facets():
    rng = np.random.default_rng(3)
    for v, f in (sphere(6), soup(rng, 60), soup(rng, 200, 0.05), (np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[0, 1, 2]]))):
        corners = v[f]
        for crowded in (False, True):
            np.testing.assert_allclose(meshes.shoot(corners, np.arange(len(f)), corners, rays=40, crowded=crowded), by_all_facets(corners, rays=40), atol=1e-9)


def test_the_grid_is_used_where_it_tells_facets_apart():
    v, f = sphere(40)
    assert not meshes.RayGrid(v[f]).crowded
    v, f = soup(np.random.default_rng(1), 500, 1.0)
    assert meshes.RayGrid(v[f]).crowded


def test_rays_meet_far_fewer_facets_than_there_are():
    tests = []
    for n in (20, 40):
        v, f = sphere(n)
        grid = meshes.RayGrid(v[f])
        start = np.repeat(v[f].mean(axis=1), 20, axis=0)
        way = np.random.default_rng(1).normal(size=start.shape) * 0.2 - start
        way /= np.linalg.norm(way, axis=1)[:, None]
        grid.nearest(start, way, np.repeat(np.arange(len(f)), 20))
        tests.append(grid.tests)
        assert grid.tests < 20 * len(f) ** 1.5
    assert tests[1] < tests[0] * 4**1.5


@pytest.mark.parametrize("leaf, asked", [(4, 16), (128, 256)])
def test_values_of_models_do_not_depend_on_cells(spark, leaf, asked):
    rng = np.random.default_rng(4)
    models = {0: sphere(8), 1: soup(rng, 80), 2: (np.zeros((3, 3)), np.array([[0, 1, 2]]))}
    got = meshes.facet_values(*tables(spark, models), rays=30, leaf=leaf, asked=asked).toPandas()
    for m, (v, f) in models.items():
        own = got[got.model_id == m].sort_values("face_id").value.to_numpy(float)
        np.testing.assert_allclose(own, by_all_facets(v[f], rays=30), atol=1e-9)


def found_problems(spark, models):
    out = {}
    for r in meshes.problems(*tables(spark, models)).collect():
        out.setdefault(r.model_id, {})[r.problem] = r.n
    return out


def test_problems_of_meshes(spark):
    v, f = sphere(4)
    open_ = f[:-3]
    flipped = f.copy()
    flipped[0] = flipped[0][[0, 2, 1]]
    tip = np.concatenate((f, f + len(v)))  # two spheres that share one vertex
    tip[tip == len(v)] = 0
    models = {0: (v, f), 1: (v, open_), 2: (v, flipped), 3: (v, np.concatenate((f, [[0, 0, 1], [1, 2, 999]]))), 4: (v, f[:0]), 5: (np.concatenate((v, v + 9)), tip), 6: (v, np.concatenate((f, f[:1])))}
    got = found_problems(spark, models)
    none, missing, flat, twice, apart = meshes.PROBLEMS
    assert 0 not in got and 1 not in got
    assert got[2][twice] == 3 and got[4] == {none: 1} and got[5] == {apart: 1} and got[6][twice] == 3
    assert got[3][missing] == 1 and got[3][flat] == 1


def test_an_invalid_mesh_is_refused_with_its_reason(spark, tmp_path):
    (tmp_path / "good.off").write_text("OFF\n4 4 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 2 1\n3 0 1 3\n3 1 2 3\n3 2 0 3\n")
    assert actions.compute_sdf(spark, str(tmp_path / "good.off")).count() == 4
    (tmp_path / "bad.off").write_text("OFF\n4 4 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2\n3 0 1 3\n3 1 2 3\n3 2 0 3\n")
    with pytest.raises(ValueError, match="bad: edge twice in one direction"):
        actions.compute_sdf(spark, str(tmp_path / "*.off"))


def smooth(f, value):
    """Bilateral means over facets a window of edges away, by breadth-first search."""
    edges = {}
    for i, t in enumerate(f):
        for a, b in zip(t, np.roll(t, -1)):
            edges.setdefault(frozenset((int(a), int(b))), set()).add(i)
    near = [set().union(*(edges[frozenset((int(a), int(b)))] for a, b in zip(t, np.roll(t, -1)))) - {i} for i, t in enumerate(f)]
    w = int(np.sqrt(len(f) / 2000)) + 1
    out = []
    for i in range(len(f)):
        level, todo = {i: 0}, [i]
        for k in range(1, w + 1):
            todo = [x for y in todo for x in near[y] if x not in level and not level.update({x: k})]
        k, v = np.array(list(level.values())), value[list(level)]
        off = v - value[i]
        dev = np.sqrt((off**2).mean())
        g = np.exp(-0.5 * (k / (w / 2)) ** 2) * (np.exp(-0.5 * (off / (1.5 * dev)) ** 2) if dev else 1)
        out.append((v * g).sum() / g.sum())
    return np.array(out)


def test_smoothing_equals_breadth_first_search(spark):
    rng = np.random.default_rng(5)
    models = {0: sphere(6), 1: sphere(34)}  # windows of one and of two edges
    value = {m: rng.random(len(f)) for m, (_, f) in models.items()}
    values = spark.createDataFrame([(m, i, float(x)) for m, own in value.items() for i, x in enumerate(own)], "model_id int, face_id int, value double")
    _, faces = tables(spark, models)
    got = meshes.smoothed(values, meshes.neighbors(faces)).toPandas()
    for m, (_, f) in models.items():
        np.testing.assert_allclose(got[got.model_id == m].sort_values("face_id").value.to_numpy(), smooth(f, value[m]), atol=1e-9)


def test_missing_values_come_from_neighbours(spark):
    _, faces = tables(spark, {0: (np.zeros((5, 3)), np.array([[0, 1, 2], [0, 2, 3], [0, 3, 4]])), 1: (np.zeros((3, 3)), np.array([[0, 1, 2]]))})
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (1, 0, None)], "model_id int, face_id int, value double")
    got = {(r.model_id, r.face_id): r.value for r in meshes.filled(values, meshes.neighbors(faces)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 0.0}


def test_rays_in_a_crowd_meet_only_facets_near_their_start():
    """Large facets that cross each other: of 3,000 a ray meets a few (all of them before)."""
    rng = np.random.default_rng(8)
    v, f = soup(rng, 3000, 1.0)
    grid, n = meshes.RayGrid(v[f]), 200
    ways = rng.normal(size=(n, 20, 3))
    ways /= np.linalg.norm(ways, axis=2)[:, :, None]
    starts = v[f][:n].mean(axis=1)
    got = grid.nearest_of_all(starts, ways, np.arange(n))
    assert grid.crowded and grid.tests < 0.2 * len(f) * n * 20
    for i in range(n):
        np.testing.assert_allclose(got[i], grid.of_all(starts[i], ways[i], np.flatnonzero(np.arange(len(f)) != i)))


def test_facets_met_in_parts_give_the_same_values(spark):
    models = {0: soup(np.random.default_rng(9), 400, 1.0), 1: sphere(10)}
    whole, parts = (meshes.facet_values(*tables(spark, models), rays=30, leaf=64, asked=asked).toPandas().sort_values(["model_id", "face_id"]) for asked in (None, 100))
    np.testing.assert_allclose(whole.value.to_numpy(float), parts.value.to_numpy(float))
    v, f = models[0]
    np.testing.assert_allclose(whole[whole.model_id == 0].value.to_numpy(float), by_all_facets(v[f], rays=30), atol=1e-9)
