"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import os

import pytest

from pointloom.plans.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")


def flat(rows):
    return sorted(tuple("null" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert flat(tuple(r) for r in got.select(*cols).collect()) == flat(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_structure_inference_does_the_whole_job(spark, sf_dir, monkeypatch):
    """All 27 features, the symmetry groups, points over 0.2, and forest and solver at their defaults."""
    from pyspark.sql import functions as F

    from pointloom.operators import learning
    from pointloom.plans import actions

    given = {}
    monkeypatch.setattr(learning, "train", lambda features, **b: given.update(train=b, features=features.columns))
    monkeypatch.setattr(learning, "distributions", lambda *a: spark.createDataFrame([(0, 1, 0, 0.22), (0, 2, 0, 0.2)], "model_id int, point_id long, label int, prob double"))
    monkeypatch.setattr(actions, "train_part_relations", lambda p: None)
    monkeypatch.setattr(actions, "infer_structure", lambda p, dist, priors, symmetry, **b: given.update(infer=b, groups=symmetry.count()) or dist)
    sharp = QUERIES["structure_inference"](spark, sf_dir).where(F.col("label") == 0)
    assert {r.point_id: r.prob for r in sharp.collect()} == {1: 0.8, 2: 0.2}
    assert given["train"] == {"trees": 100} and not given["infer"] and given["groups"] == 4
    assert set(learning.FEATURES) < set(given["features"])


def test_rays_and_trees_are_the_operators_defaults(spark, sf_dir, monkeypatch):
    from pointloom.operators import learning, meshes

    given = []
    monkeypatch.setattr(meshes, "mesh_sdf", lambda *a, **b: given.append(b))
    monkeypatch.setattr(learning, "train", lambda *a, **b: given.append(b))
    monkeypatch.setattr(learning, "distributions", lambda *a: None)
    monkeypatch.setattr(learning, "with_null_label", lambda *a: None)
    QUERIES["mesh_sdf"](spark, sf_dir)
    QUERIES["rf_predict"](spark, sf_dir)
    assert given == [{}, {}]
