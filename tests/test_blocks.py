"""Neighbourhoods by blocks against all pairs."""

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import blocks, spatial

POINT = "model_id long, point_id long, x double, y double, z double"


def clouds(rng):
    """Models by shape: a ball, a lattice with ties, copies of one place, a far clump, one point."""
    far = np.vstack((rng.normal(size=(150, 3)) * 1e-3, rng.normal(size=(20, 3)) + 50))
    return {0: rng.normal(size=(400, 3)) * 0.2, 1: np.round(rng.random((200, 3)) * 4) / 4, 2: np.full((40, 3), 0.3), 3: far, 4: np.ones((1, 3))}


def rows_of(models):
    return [(m, i, *map(float, p)) for m, own in models.items() for i, p in enumerate(own)]


def squares(p, others=None):
    d = p[:, None] - (p if others is None else others)[None]
    return (d[..., 0] ** 2 + d[..., 1] ** 2) + d[..., 2] ** 2


@pytest.fixture
def small(monkeypatch):
    """Many blocks and parts at a small size."""
    for name, value in (("LEAST_BLOCK", 16), ("WANTED", 24), ("HELD", 64), ("RUN", 8), ("LEAF", 4), ("TOGETHER", 3)):
        monkeypatch.setattr(blocks, name, value)


def test_moments_within_radii(spark, small):
    models, squared = clouds(np.random.default_rng(0)), [0.04, 0.25]
    rows = [*rows_of(models), (0, 1000, None, 0.0, 0.0), (0, 1001, float("nan"), 0.0, 0.0), (0, 1002, float("inf"), 0.0, 0.0)]
    got = blocks.around(spark.createDataFrame(rows, POINT), squared).toPandas().set_index(["model_id", "src"]).sort_index()
    assert len(got) == sum(map(len, models.values()))
    for m, p in models.items():
        own, inside = got.loc[m], squares(p)
        for k, r2 in enumerate(squared):
            near = inside <= r2
            assert (own[f"n{k}"].to_numpy() == near.sum(axis=1)).all()
            for c in blocks.SIX:
                a, b = ("xyz".index(x) for x in c)
                raw = near @ (p[:, a] * p[:, b]) / near.sum(axis=1)
                np.testing.assert_allclose(own[f"raw{k}{c}"], raw, atol=1e-9)
                np.testing.assert_allclose(own[f"mid{k}{c}"], raw - near @ p[:, a] / near.sum(axis=1) * (near @ p[:, b] / near.sum(axis=1)), atol=1e-9)


@pytest.mark.parametrize("raw, mid", [(False, False), (True, False), (False, True)])
def test_only_what_is_wanted_is_summed(spark, small, raw, mid):
    """Counts alone, raw or centred moments alone are what all together give."""
    models, squared = clouds(np.random.default_rng(11)), [0.04, 0.25]
    points = spark.createDataFrame(rows_of(models), POINT)
    got = blocks.around(points, squared, raw=raw, mid=mid).toPandas().set_index(["model_id", "src"]).sort_index()
    want = blocks.around(points, squared).toPandas().set_index(["model_id", "src"]).sort_index()
    names = [c for c in want.columns if c[0] == "n" or (raw and c[:3] == "raw") or (mid and c[:3] == "mid")]
    assert sorted(got.columns) == sorted(names)
    for c in names:
        np.testing.assert_allclose(got[c], want[c], atol=1e-9)
    for m, p in models.items():
        for k, r2 in enumerate(squared):
            assert (got.loc[m][f"n{k}"].to_numpy() == (squares(p) <= r2).sum(axis=1)).all()


def test_leaves_inside_a_radius_count_by_their_sums(monkeypatch):
    """Of all pairs of a dense cloud and its radii few are met."""
    p = np.random.default_rng(1).random((20_000, 3))
    p = p[np.argsort(blocks.z_order(p))]
    met, plain = [], blocks.squares
    monkeypatch.setattr(blocks, "squares", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    got = blocks.ball_sums(p[:512], p, np.ones((len(p), 1)), [0.01, 0.5])
    assert sum(met) < 0.35 * 2 * 512 * len(p)
    assert (got[:64, 1, 0] == (plain(p[:64], p) <= 0.5).sum(axis=1)).all()


def test_sums_compare_pairs_by_products_and_ties_exactly(monkeypatch):
    """Points of a lattice far from the origin, many just at a radius: no array of differences is made, and none is lost."""
    p = np.round(np.random.default_rng(8).random((3000, 3)) * 8) / 8 + [1000.1, -3.3, 0.7]
    want = np.stack([squares(p[:100], p) <= r2 for r2 in (0.0625, 0.25)], axis=1).sum(axis=2)
    monkeypatch.setattr(blocks, "squares", None)
    p = np.vstack((p[:100], p[100:][np.argsort(blocks.z_order(p[100:]), kind="stable")]))
    assert (blocks.ball_sums(p[:100], p, np.ones((len(p), 1)), [0.0625, 0.25])[:, :, 0] == want).all()


def test_half_of_the_digits_tell_distances_where_own_points_are_close(monkeypatch):
    """Others lie in doubt, a hair inside and outside a radius, or far off; own points far apart need all digits."""
    kinds, plain = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: kinds.append(out.dtype) or plain(a, b, out=out))
    rng = np.random.default_rng(10)
    own, way = rng.random((50, 3)) * 0.1 + [7.0, -3.0, 1e3], rng.normal(size=(4000, 3))
    way *= (0.2 + rng.choice([-1e-9, 0, 1e-9, 1e-3], (4000, 1))) / np.linalg.norm(way, axis=1)[:, None]
    for apart, kind in ((0.0, np.float32), (40.0, np.float64)):
        kinds.clear()
        p = np.vstack((own, own[:1] + apart))
        others = np.asfortranarray(np.vstack((p[rng.integers(0, len(p), 4000)] + way, [[1e9, 0, 0]])))
        got = blocks.ball_sums(p, others, np.ones((len(others), 1)), [0.04, 0.09])[:, :, 0]
        assert (got == np.stack([squares(p, others) <= r2 for r2 in (0.04, 0.09)], axis=1).sum(axis=2)).all()
        assert set(kinds) == {np.dtype(kind)}


def test_work_items_are_few_rows(spark, small):
    """A row for each block that an item meets, not for each point in it."""
    rows = rows_of({0: np.random.default_rng(9).random((400, 3))})
    made = blocks.Blocks(spark.createDataFrame(rows, POINT))
    pairs = made.pairs(None)
    assert made.items(pairs).count() == pairs.count() + pairs.select("s", "part").distinct().count()


def test_pairs_within_a_radius(spark, small):
    models = clouds(np.random.default_rng(2))
    got = spatial.radius_join(spark.createDataFrame(rows_of(models), POINT), 0.25).toPandas()
    for m, p in models.items():
        own, d2 = got[got.model_id == m], squares(p)
        assert set(zip(own.src, own.dst)) == set(zip(*np.nonzero(d2 <= 0.25 * 0.25))) and len(own) == (d2 <= 0.25 * 0.25).sum()
        assert (own.d2.to_numpy() == d2[own.src, own.dst]).all() and (own[["dx", "dy", "dz"]].to_numpy() == p[own.dst]).all()


def test_pairs_are_rounded_where_they_are_found(spark, small):
    """As SQL rounds; Spark adds neither a rounding nor another column to each of the pairs."""
    duckdb = pytest.importorskip("duckdb")
    p = np.concatenate((np.random.default_rng(12).random(20_000) * 0.01, (np.arange(4000) + 0.5) * 1e-6, np.nextafter((np.arange(400) + 0.5) * 1e-6, 0), [0.0, 1e300, 5e-324, 0.49999999999999994e-6]))
    want = duckdb.sql("SELECT round(v, 6) + 0.0 FROM (SELECT unnest($v) AS v)", params={"v": p.tolist()}).fetchall()
    assert blocks.half_up(p, 6).tolist() == [v for (v,) in want]
    own = clouds(np.random.default_rng(2))[1]
    got = spatial.radius_join(spark.createDataFrame(rows_of({0: own / 3}), POINT), 0.25, places=False, digits=3, models=False)
    d2 = squares(own / 3)
    assert got.columns == ["src", "dst", "d2"]
    assert sorted(map(tuple, got.collect())) == [(i, j, float(blocks.half_up(d2[i : i + 1, j], 3)[0])) for i, j in zip(*np.nonzero(d2 <= 0.25 * 0.25))]


def test_query_of_pairs_leaves_nothing_to_do_a_pair(spark, sf_dir):
    from pointloom.plans.queries import QUERIES

    plan = QUERIES["radius_neighbors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "FlatMapGroupsInArrow"


@pytest.mark.parametrize("named", [int, "p{:04d}".format])
def test_nearest_with_ties(spark, small, named):
    models = clouds(np.random.default_rng(3))
    rows = [(m, named(i), *p) for m, i, *p in rows_of(models)]
    got = spatial.knn(spark.createDataFrame(rows, POINT if named is int else POINT.replace("point_id long", "point_id string")), 5).toPandas()
    want = []
    for m, p in models.items():
        for i, d2 in enumerate(squares(p)):
            d2[i] = np.inf
            want += [(m, named(i), named(int(j)), d2[j], rank) for rank, j in enumerate(np.lexsort((np.arange(len(p)), d2))[: min(5, len(p) - 1)], 1)]
    want = pd.DataFrame(want, columns=["model_id", "src", "dst", "d2", "rank"])
    pd.testing.assert_frame_equal(got.sort_values(["model_id", "src", "rank"], ignore_index=True), want, check_dtype=False)


def test_only_near_blocks_are_met_by_nearest(spark, monkeypatch):
    """A block meets few others, however wide the cloud is."""
    seen, plain = [], blocks.Blocks.pairs
    monkeypatch.setattr(blocks.Blocks, "pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    p = np.random.default_rng(4).random((6000, 3)) * [20, 1, 1]
    assert spatial.knn(spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], POINT), 4, 5.0).count() == 24_000
    assert seen[0].count() < 0.5 * (6000 / blocks.LEAST_BLOCK + 1) ** 2


def test_components_by_cells(spark):
    """Chains, dense balls a little nearer or farther than the radius, boxes that tell nothing."""
    rng = np.random.default_rng(5)
    ball = rng.normal(size=(300, 3)) * 0.02
    bow = np.column_stack((np.cos(np.linspace(0, 5, 40)), np.sin(np.linspace(0, 5, 40)), np.zeros(40))) * 0.7
    comb = np.vstack([[[0, 0.01 * i, 0.0] for i in range(20)], [[0.12, 0.01 * i, 0.09] for i in range(20)]])
    models = {0: rng.random((250, 3)) * 1.2, 1: np.vstack((ball, ball + [0.25, 0, 0], ball + [0.6, 0, 0])), 2: bow, 3: comb, 4: np.zeros((5, 3))}
    rows = [*rows_of(models), (0, 1000, None, 0.0, 0.0)]
    for radius in (0.1, 0.149, 0.1501, 0.2):
        got = {(r.model_id, r.point_id): r.component for r in spatial.radius_components(spark.createDataFrame(rows, POINT), radius).collect()}
        assert got.pop((0, 1000)) == 1000 and len(got) == len(rows) - 1
        for m, p in models.items():
            near, label = squares(p) <= radius * radius, np.arange(len(p))
            while (least := np.where(near, label[None], len(p)).min(axis=1)).tolist() != label.tolist():
                label = least
            assert [got[m, i] for i in range(len(p))] == label.tolist()


def test_components_make_no_pairs_of_a_dense_cloud(spark, monkeypatch):
    seen, plain = [], spatial.stored
    labels = []
    monkeypatch.setattr(spatial, "stored", lambda df, label: labels.append(label) or seen.append(plain(df, label)) or seen[-1])
    p = np.random.default_rng(6).random((4000, 3)) * 0.3
    got = spatial.radius_components(spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], POINT), 0.1)
    assert {r.component for r in got.collect()} == {0} and max(df.count() for df in seen) < 8000
    assert seen[labels.index("doubtful")].isEmpty()


def test_thinning_stores_few_links_of_a_dense_cloud(spark, monkeypatch):
    from .test_thinning import greedy

    monkeypatch.setattr(spatial, "FIRST_THINNED", 100)
    seen, plain = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, label: seen.append(plain(df, label)) or seen[-1])
    p = np.random.default_rng(7).random((3000, 3)) * 0.5
    got = spatial.thinned(spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], POINT), 0.2).collect()
    assert {r.point_id for r in got} == greedy(list(enumerate(p)), 0.2) and max(df.count() for df in seen) < 20_000
