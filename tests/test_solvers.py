"""Solvers and scalar geometry against enumeration, numpy and solids with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import energy_tables as V
from pointloom.functions import geometry as G
from pointloom.operators import mrf, parts, solids, spatial


def best(graph):
    return min(graph.energy(x) for x in itertools.product(*[range(len(c)) for c in graph.costs]))


def chain(costs, edges):
    g = mrf.Graph()
    for c in costs:
        g.add_node(c)
    for e in edges:
        g.add_edge(*e)
    return g


SIX_2D = [np.arange(6.0), np.zeros(6)]


@pytest.mark.parametrize(
    "graph,energy",
    [
        (chain([[0, 1, 2], [3, 4, 5], [7, 8]], [(0, 1, V.potts(3, 6)), (1, 2, V.general([[y * y + z for z in (0, 1)] for y in (0, 1, 2)]))]), 10),
        (chain([[0, 1, 2], [3, 4, 5]], [(0, 1, V.potts(3, 6))]), 3),
        (chain([[0, 1], [2, 3]], [(0, 1, V.binary(4, 5, 6, 7))]), 6),
        (chain([[0, 1, 2], [3, 4, 5]], [(0, 1, V.truncated_linear(3, 6, 7))]), 3),
        (chain([[0, 1, 2], [3, 4, 5]], [(0, 1, V.truncated_quadratic(3, 6, 7))]), 3),
        (chain(SIX_2D, [(0, 1, V.truncated_linear_2d(2, 3, 6, 7, 8))]), 0),
        (chain(SIX_2D, [(0, 1, V.truncated_quadratic_2d(2, 3, 6, 7, 8))]), 0),
    ],
)
@pytest.mark.parametrize("method", ["trws", "bp"])
def test_worked_energies(graph, energy, method):
    got = mrf.minimize(graph, method)
    assert best(graph) == got.energy == energy


def test_trws_bounds_random_graphs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k = 6, 3
        g = chain(rng.random((n, k)), [(i, j, rng.random((k, k))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5])
        got, last = mrf.minimize(g, iterations=50), -np.inf
        assert got.lower_bound <= best(g) + 1e-9 <= got.energy + 2e-9
        for it in (1, 3, 10):
            bound = mrf.minimize(g, iterations=it).lower_bound
            assert bound >= last - 1e-9
            last = bound
        assert sorted(mrf.automatic_order(n, g.edges)) == list(range(n))
        assert mrf.minimize(g, seed=3, eps=1e-9).iterations <= 100
    tree = chain(rng.random((5, 3)), [(i, i + 1, rng.random((3, 3))) for i in range(4)])
    assert mrf.minimize(tree).energy == pytest.approx(best(tree)) == pytest.approx(mrf.minimize(tree).lower_bound)
    with pytest.raises(ValueError):
        tree.add_edge(0, 0, np.zeros((3, 3)))


def test_ball(spark):
    cube = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    center, radius = solids.ball(cube)
    assert center == pytest.approx([0.5] * 3) and radius == pytest.approx(np.sqrt(3) / 2)
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 200):
        pts = rng.normal(size=(n, 3))
        center, radius = solids.ball(pts)
        d = np.linalg.norm(pts - center, axis=1)
        assert d.max() <= radius + 1e-7 and (n == 1 or (np.abs(d - radius) < 1e-7).sum() >= 2)
    rows = [(m, i, *map(float, p)) for m in (0, 1) for i, p in enumerate(rng.normal(size=(300, 3)) * (1 + m))]
    df = spark.createDataFrame(rows, "model_id int, point_id int, x double, y double, z double")
    for r in solids.balls(df).collect():
        own = np.array([x[2:] for x in rows if x[0] == r.model_id])
        assert r.radius == pytest.approx(solids.ball(own)[1], rel=1e-6)
    unit = solids.normalize(df).groupBy("model_id").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r")).collect()
    assert [x.r for x in unit] == pytest.approx([1.0, 1.0])


def test_eigen_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    mats = [(a + a.T) for a in rng.normal(size=(50, 3, 3))] + [np.eye(3), np.zeros((3, 3)), np.diag([3.0, 1, 1])]
    rows = [(i, float(m[0, 0]), float(m[0, 1]), float(m[0, 2]), float(m[1, 1]), float(m[1, 2]), float(m[2, 2])) for i, m in enumerate(mats)]
    df = spark.createDataFrame(rows, "id int, xx double, xy double, xz double, yy double, yz double, zz double")
    got = G.with_eigen(df, {"v": [F.col(c) for c in G.SIX]}, ("v",)).collect()
    for r in got:
        m, want = mats[r.id], np.linalg.eigvalsh(mats[r.id])[::-1]
        assert [r.v_1, r.v_2, r.v_3] == pytest.approx(want, abs=1e-7)
        for value, vector in ((r.v_1, r.v_e1), (r.v_3, r.v_e3)):
            if vector is not None and r.id < 50:
                assert m @ np.array(vector) == pytest.approx(value * np.array(vector), abs=1e-6)
                assert np.linalg.norm(vector) == pytest.approx(1) and vector[int(np.abs(vector).argmax())] > 0


def test_radius_join_edges_and_knn(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack((rng.normal(size=(80, 3)), [[0.0, 0, 0], [0.5, 0, 0], [0.5, 0, 0], [50, 0, 0]]))
    df = spark.createDataFrame([(m, i, *map(float, p)) for m in (0, 1) for i, p in enumerate(pts)], "model_id int, point_id int, x double, y double, z double")
    d = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    got = {(r.src, r.dst) for r in spatial.radius_join(df, 0.5).where("model_id = 0").collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 0.25))}
    near = spatial.knn(df, 5, 0.2).where("model_id = 1").collect()
    for i in range(len(pts)):
        want = sorted((d[i, j], j) for j in range(len(pts)) if j != i)[:5]
        assert sorted((r["rank"], r.dst) for r in near if r.src == i) == [(k + 1, j) for k, (_, j) in enumerate(want)]
    assert spatial.radius_join(df.where("false"), 0.5).count() == 0


def test_components_long_chain(spark):
    n = 200
    nodes = spark.range(n + 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "src long, dst long")
    got = {r.id: r.component for r in spatial.components(nodes, edges).collect()}
    assert got == {i: 0 if i < n else n if i < n + 2 else i for i in range(n + 3)}


def test_frames_and_boxes(spark):
    assert len(parts.FRAMES) == 24 and sum(f[-1] for f in parts.FRAMES) == 0
    rng = np.random.default_rng(5)
    rows = [(0, i, *map(float, p), label) for label, (c, s) in enumerate([((0, 0, 0), (4, 2, 1)), ((9, 0, 0), (1, 2, 4))]) for i, p in enumerate(np.array(c) + (rng.random((400, 3)) - 0.5) * s)]
    df = spark.createDataFrame(rows, "model_id int, point_id int, x double, y double, z double, part_label int")
    got = {r.part_label: r for r in parts.part_boxes(df).collect()}
    assert got[0].scale == pytest.approx([4, 2, 1], abs=0.3) and got[1].scale == pytest.approx([1, 2, 4], abs=0.3)
    assert got[1].trans == pytest.approx([9, 0, 0], abs=0.2)
    rel = {(r.label1, r.label2): r.feat for r in parts.pair_relations(parts.part_boxes(df)).collect()}
    assert len(rel) == 2 and rel[0, 1][:16] == pytest.approx(rel[1, 0][16:]) and len(rel[0, 1]) == 32


def test_mesh_sdf_of_a_slab():
    from pointloom.operators import meshes
    from pointloom.operators.parts import TRIANGLES

    v = np.array(list(itertools.product((0.0, 10.0), (0.0, 1.0), (0.0, 10.0))))
    f = np.array(TRIANGLES)
    mid = v.mean(axis=0)
    for i, (a, b, c) in enumerate(f):  # outward
        n = np.cross(v[b] - v[a], v[c] - v[a])
        if n @ (v[[a, b, c]].mean(axis=0) - mid) < 0:
            f[i] = (a, c, b)
    sdf = meshes.shoot(v[f], np.arange(len(f)), v[f], rays=50)
    flat = [i for i, t in enumerate(f) if len({v[x][1] for x in t}) == 1]
    assert len(flat) == 4 and sdf[flat] == pytest.approx([1.0] * 4, abs=0.1)


def test_normals_of_a_plane_and_orientation(spark):
    rng = np.random.default_rng(6)
    pts = np.column_stack((rng.random((60, 2)), np.zeros(60)))
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "model_id int, point_id int, x double, y double, z double")
    got = solids.jet_normals(df).collect()
    assert [abs(r.nz) for r in got] == pytest.approx([1.0] * 60, abs=1e-6)
    mixed = df.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.when(F.col("point_id") % 2 == 0, 1.0).otherwise(-1.0)})
    assert {r.nz for r in solids.orient_normals(mixed).collect()} == {1.0}
