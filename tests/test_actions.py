"""Each user action on written files, and the numbers behind structure inference against numpy."""

import glob
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import learning, mrf, parts, solids, spatial
from pointloom.plans import actions
from pointloom.sources import formats

SEAT, BACK = ((0.0, 0.0, 0.0), (4.0, 1.0, 4.0)), ((0.0, 1.5, -1.8), (4.0, 4.0, 0.4))


def box_mesh(centre, size, n=4):
    """Corners and triangles of a box's six sides, each in n x n squares."""
    v, f = [], []
    for axis, sign in itertools.product(range(3), (-1, 1)):
        first = len(v)
        for i, j in itertools.product(range(n + 1), repeat=2):
            p = np.zeros(3)
            p[axis], p[(axis + 1) % 3], p[(axis + 2) % 3] = sign / 2, i / n - 0.5, j / n - 0.5
            v.append(np.array(centre) + p * size)
        for i, j in itertools.product(range(n), repeat=2):
            a, b, c, d = (first + (i + x) * (n + 1) + j + y for x, y in ((0, 0), (1, 0), (1, 1), (0, 1)))
            f += [(a, b, c), (a, c, d)] if sign > 0 else [(a, c, b), (a, d, c)]
    return np.array(v), np.array(f)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three chairs of a seat (label 1) and a back (label 4), as OFF, SEG and SDFF."""
    root = tmp_path_factory.mktemp("chairs")
    for kind in ("off", "gt", "sdff"):
        (root / kind).mkdir()
    for m in range(3):
        (v1, f1), (v2, f2) = (box_mesh(np.array(c) * (1 + m / 10), np.array(s) * (1 + m / 10)) for c, s in (SEAT, BACK))
        v, f = np.vstack((v1, v2)), np.vstack((f1, f2 + len(v1)))
        lines = ["OFF", f"{len(v)} {len(f)} 0", *(" ".join(map(str, p)) for p in v.tolist()), *("3 " + " ".join(map(str, t)) for t in f.tolist())]
        (root / "off" / f"{m}.off").write_text("\n".join(lines) + "\n")
        (root / "gt" / f"{m}.seg").write_text("\n".join(["1"] * len(f1) + ["4"] * len(f2)) + "\n")
        (root / "sdff" / f"{m}.sdff").write_text("\n".join(str(i / len(v)) for i in range(len(v))) + "\n")
    return root


@pytest.fixture(scope="module")
def chairs(spark, folder):
    points = actions.open_models(spark, f"{folder}/off/*.off", seg=f"{folder}/gt/*.seg", sdff=f"{folder}/sdff/*.sdff")
    return spatial.checkpointed(spark, points)


def test_open_joins_labels_and_values(chairs):
    rows = chairs.toPandas()
    assert sorted(rows.model_id.unique()) == ["0", "1", "2"] and len(rows) == 3 * 300
    for _, own in rows.groupby("model_id"):
        assert np.sqrt((own[["x", "y", "z"]] ** 2).sum(axis=1)).max() == pytest.approx(1, abs=1e-6)
        assert ((own[["nx", "ny", "nz"]] ** 2).sum(axis=1) - 1).abs().max() < 1e-9
        assert own.set_index("point_id").part_label.to_dict() == {i: 1 if i < 150 else 4 for i in range(300)}
        assert own.set_index("point_id").sdf.to_dict() == pytest.approx({i: i / 300 for i in range(300)})


def test_plain_open_has_radius_normals(spark, folder):
    rows = actions.open_models(spark, f"{folder}/off/0.off", "plain").collect()
    assert len(rows) == 300 and {"nx", "ny", "nz"} < set(rows[0].asDict())


def test_xyz_open(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("\n".join(f"{i} {i * i % 7} 1 0 0 2" for i in range(20)) + "\n")
    rows = actions.open_models(spark, str(tmp_path / "m.xyz"), "xyz").collect()
    assert len(rows) == 20 and {(r.nx, r.ny, r.nz) for r in rows} == {(0, -1, 0)}


def test_save_writes_one_ply_a_model(chairs, tmp_path):
    actions.save_models(chairs, str(tmp_path / "ply"))
    for m in "012":
        (path,) = glob.glob(f"{tmp_path}/ply/model_id={m}/part*")
        lines = open(path).read().splitlines()
        assert lines[2] == "element vertex 300" and lines[9] == "end_header" and len(lines) == 310


def test_features_classifier_and_predictions(spark, chairs, tmp_path):
    found = actions.extract_point_features(chairs, str(tmp_path / "f"), chairs.select("model_id", "point_id", "sdf"))
    assert found.count() == 900 and set(learning.FEATURES) < set(found.columns)
    assert [r.part_label for r in spark.read.parquet(f"{tmp_path}/f/labels").collect()] == [1, 4]
    # One file a model that reads back with its own name.
    formats.write_features(found, str(tmp_path / "csv"))
    back = formats.read_features(spark, f"{tmp_path}/csv/*/part*")
    assert {r.model_id: r["count"] for r in back.groupBy("model_id").count().collect()} == {"0": 300, "1": 300, "2": 300}
    both = back.join(found.select("model_id", "point_id", F.col("sdf").alias("sdf2"), F.col("part_label").alias("label2")), ["model_id", "point_id"])
    assert both.where("abs(sdf - sdf2) < 1e-6 AND part_label = label2").count() == 900
    actions.train_point_classifier(found, str(tmp_path / "rf"), trees=20)
    dist = actions.test_point_cloud(str(tmp_path / "rf"), found)
    assert {(r.label, r.n) for r in dist.groupBy("label").agg(F.count("*").alias("n")).collect()} == {(1, 900), (4, 900), (5, 900)}
    best = learning.best_label(dist.where("label < 5")).join(found, ["model_id", "point_id"])
    assert best.where("label = part_label").count() > 850
    formats.write_predictions(dist, str(tmp_path / "p"))
    again = formats.read_predictions(spark, f"{tmp_path}/p/*/part*")
    assert sorted(again.select("model_id", "point_id", "label", "prob").collect()) == sorted(dist.select("model_id", "point_id", "label", "prob").collect())


def test_mesh_actions(spark, folder, tmp_path):
    sdf = actions.compute_sdf(spark, f"{folder}/off/*.off").toPandas()
    assert len(sdf) == 900 and sdf.sdf.between(0, 1).all() and sdf.groupby("model_id").sdf.max().min() > 0.5
    actions.normalize_meshes(spark, f"{folder}/off/*.off", str(tmp_path / "n"))
    v, f = formats.read_off(spark, f"{tmp_path}/n/*/part*")
    assert f.count() == 3 * 384 and {r.model_id for r in v.select("model_id").distinct().collect()} == {"0", "1", "2"}
    far = v.groupBy("model_id").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r")).collect()
    assert [r.r for r in far] == pytest.approx([1.0] * 3, abs=1e-6)


def test_boxes_triangles_and_priors(spark, chairs, tmp_path):
    boxes = actions.compute_obb(chairs)
    assert boxes.count() == 6
    obb = parts.as_obb(boxes)
    same = parts.as_part(obb).join(boxes.withColumnsRenamed({c: f"{c}2" for c in ("rot", "trans", "scale", "height", "axes")}), ["model_id", "part_label"]).collect()
    for r in same:
        for c in ("rot", "trans", "scale", "axes", "height"):
            assert r[c] == pytest.approx(r[f"{c}2"])
    tri = parts.box_triangles(boxes).toPandas()
    box = {(r.model_id, r.part_label): r for r in boxes.collect()}
    for key, own in tri.groupby(["model_id", "part_label"]):
        scale, axes = np.array(box[key].scale), np.array(box[key].axes).reshape(3, 3)
        area = [np.linalg.norm(np.cross(np.subtract(b, a), np.subtract(c, a))) / 2 for a, b, c in zip(own.a, own.b, own.c)]
        assert len(own) == 12 and sum(area) == pytest.approx(2 * (scale[0] * scale[1] + scale[1] * scale[2] + scale[0] * scale[2]))
        assert sorted(np.abs(np.array(own.normal.tolist()) @ axes.T).argmax(axis=1)) == [0] * 4 + [1] * 4 + [2] * 4
        assert np.array(own.normal.tolist()).sum(axis=0) == pytest.approx([0] * 3)
    cells = actions.train_part_relations(chairs)
    formats.write_priors(cells, str(tmp_path / "prior"))
    back = formats.read_prior_cells(spark, f"{tmp_path}/prior/mean", f"{tmp_path}/prior/cov")
    key = lambda df: sorted((r.label1, r.label2, r.i, r.j, r.mean_i, r.mean_j, r["cov"]) for r in df.collect())
    assert len(key(back)) == 2 * 528 and [x for r in key(back) for x in r] == pytest.approx([x for r in key(cells) for x in r])


def test_inverses_and_pair_costs_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rel = rng.normal(size=(2, 50, 32))
    df = spark.createDataFrame([(a, 1 - a, rel[a, n].tolist()) for a in range(2) for n in range(50)], "label1 int, label2 int, feat array<double>")
    inverses = parts.prior_inverses(parts.priors(df))
    for r in inverses.collect():
        own = rel[r.label1]
        assert r.mean == pytest.approx(own.mean(axis=0).tolist())
        assert np.reshape(r.inverse, (32, 32)) == pytest.approx(np.linalg.inv(np.cov(own.T)), rel=1e-6)
    rows = [(0, c, c // 2, *[rng.normal(size=n).tolist() for n in (9, 3, 3, 4)]) for c in range(6)]
    cands = spark.createDataFrame(rows, "model_id int, cand_id int, cluster_no int, rot array<double>, trans array<double>, scale array<double>, height array<double>")
    labels = spark.createDataFrame([(2,), (0,), (1,)], "label int")
    got = {(r.i, r.j, r.label1, r.label2): r.cost for r in parts.pairwise_energy(cands, labels, inverses, 2).collect()}
    assert len(got) == 15 * 9

    def seen(a, b):
        ra, rb = np.reshape(a[3], (3, 3)), np.reshape(b[3], (3, 3))
        t = np.hstack((rb.T @ ra * np.array(a[5]), (rb.T @ (np.array(a[4]) - b[4]))[:, None]))
        return t.T.ravel()

    for (i, j, l1, l2), cost in got.items():
        a, b = rows[i], rows[j]
        if a[2] == b[2]:
            want = 0.0 if 2 in (l1, l2) else parts.HARD_INF
        elif 2 in (l1, l2):
            want = parts.INF / 2
        elif l1 == l2:
            want = parts.INF
        else:
            off = np.concatenate((seen(a, b), a[6], seen(b, a), b[6])) - rel[l1].mean(axis=0)
            want = parts.PAIR_WEIGHT * np.sqrt(off @ np.linalg.inv(np.cov(rel[l1].T)) @ off)
        assert cost == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError):
        parts.pair_costs(cands, spark.range(13).select(F.col("id").cast("int").alias("label")), inverses, 2)


def test_energies_of_the_registered_solvers(spark, sf_dir):
    """A solver's energy is the sum of its costs, and no labeling that is tried is below its bound."""
    from pointloom.plans import queries

    unary, pairs = queries.energies(spark, sf_dir)
    models = {}
    for r in unary.collect():
        models.setdefault(r.model_id, (np.zeros((12, 5)), {}))[0][r.node, r.label] = r.cost
    for r in pairs.collect():
        models[r.model_id][1][r.i, r.j] = np.reshape(r.costs, (5, 5))
    assert len(models) == 5 and all(len(v) == 66 for _, v in models.values())
    cost = lambda u, v, x: sum(u[i, x[i]] for i in range(12)) + sum(t[x[i], x[j]] for (i, j), t in v.items())
    rng = np.random.default_rng(1)
    for method in ("trws", "bp"):
        found = mrf.solve(unary, pairs, method).toPandas()
        for m, (u, v) in models.items():
            own = found[found.model_id == m].sort_values("node")
            energy = own.energy.iloc[0]
            assert energy == pytest.approx(cost(u, v, own.label.tolist()))
            if method == "trws":
                bound = own.lower_bound.iloc[0]
                assert bound <= energy + 1e-9 * abs(energy)
                assert min(cost(u, v, y) for y in rng.integers(0, 5, (300, 12)).tolist()) >= bound - 1e-9 * abs(bound)
    long = spark.createDataFrame([(m, i, j, a, b, float(t[a, b])) for m, (_, v) in models.items() for (i, j), t in v.items() for a in range(5) for b in range(5)], "model_id int, i int, j int, label1 int, label2 int, cost double")
    assert sorted(mrf.solve(unary, long).collect()) == sorted(mrf.solve(unary, pairs).collect())


def test_bound_and_energy_against_all_labelings(spark):
    """Eight nodes and three labels: the bound is below every labeling, and on a chain the solver finds the best."""
    rng = np.random.default_rng(7)
    u, every = rng.random((8, 3)), np.array(list(itertools.product(range(3), repeat=8)))
    unary = spark.createDataFrame([(m, i, a, float(u[i, a])) for m in (0, 1) for i in range(8) for a in range(3)], "model_id int, node int, label int, cost double")
    v = {(m, i, j): rng.random((3, 3)) for m in (0, 1) for i in range(8) for j in range(i + 1, 8) if m or j == i + 1}
    pairs = spark.createDataFrame([(m, i, j, a, b, float(t[a, b])) for (m, i, j), t in v.items() for a in range(3) for b in range(3)], "model_id int, i int, j int, label1 int, label2 int, cost double")
    found = mrf.solve(unary, pairs).toPandas()
    for m in (0, 1):
        costs = u[np.arange(8), every].sum(axis=1) + sum(t[every[:, i], every[:, j]] for (k, i, j), t in v.items() if k == m)
        own = found[found.model_id == m].sort_values("node")
        x, energy, bound = own.label.tolist(), own.energy.iloc[0], own.lower_bound.iloc[0]
        assert energy == pytest.approx(costs[np.flatnonzero((every == x).all(axis=1))[0]])
        assert bound <= costs.min() + 1e-9 and (m or energy == pytest.approx(costs.min()))


def test_inference_explains_each_part_once(spark, chairs):
    """Sure labels and two clusters a chair: of each part one of its own boxes, at the least energy of all such choices."""
    dist = chairs.select("model_id", "point_id", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.when(F.col("part_label") == 1, 0.9).otherwise(0.1).alias("prob")), F.struct(F.lit(4).alias("label"), F.when(F.col("part_label") == 4, 0.9).otherwise(0.1).alias("prob")))).alias("d"))
    dist = learning.with_null_label(dist.select("model_id", "point_id", "d.label", "d.prob"))
    priors = actions.train_part_relations(chairs)
    none = spark.createDataFrame([], "group_id int, label int, rep_label int")
    got = actions.infer_structure(chairs, dist, priors, none, radius=0.35).toPandas()
    assert sorted(zip(got.model_id, got.label)) == [(m, x) for m in "012" for x in (1, 4)]
    boxes = {(r.model_id, r.part_label): r for r in actions.compute_obb(chairs).collect()}
    for r in got.itertuples():
        assert sorted(r.scale) == pytest.approx(sorted(boxes[r.model_id, r.label].scale), rel=1e-6)
    for m in "012":
        assert got[got.model_id == m].cluster_no.nunique() == 2
    grouped = spark.createDataFrame([(0, 1, 1), (0, 4, 1)], "group_id int, label int, rep_label int")
    clouds = parts.assign_clouds(dist.where("label < 5"), grouped)
    assert {r.part for r in clouds.collect()} == {1} and clouds.count() == 900


def test_candidate_files_read_back(spark, chairs, tmp_path):
    points = chairs.where("model_id < '2'").withColumn("part", F.col("part_label")).select("model_id", "point_id", "part", "x", "y", "z")
    cands = spatial.checkpointed(spark, parts.candidates(parts.clusters(points, 0.35)))
    formats.write_candidates(cands, str(tmp_path / "c"))
    back = {(r.model_id, r.cand_id): r for r in formats.read_candidates(spark, f"{tmp_path}/c/*/*/part*").collect()}
    rows = cands.collect()
    assert len(back) == len(rows) == 96
    for r in rows:
        b = back[r.model_id, r.cand_id]
        assert (b.label, b.cluster_no, b.point_ids) == (r.part, r.cluster_no, r.point_ids)
        assert all(b[c] == r[c] for c in ("rot", "trans", "scale", "height", "axes"))
