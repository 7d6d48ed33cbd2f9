"""Text formats: read back what was written, and reject what the format rejects."""

import glob

import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import learning
from pointloom.sources import formats

OFF = "OFF\n4 2 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2\n3 0 2 3\n"


def test_off_round_trip(spark, tmp_path):
    (tmp_path / "a.off").write_text(OFF)
    (tmp_path / "b.x.off").write_text(OFF.replace("1 0 0", "2 0 0").replace("\n", "\r\n"))
    (tmp_path / "none.off").write_text("OFF\n0 0 0\n")
    v, f = formats.read_off(spark, str(tmp_path / "*.off"))
    assert {r.model_id for r in v.collect()} == {"a", "b"} and v.count() == 8 and f.count() == 4
    formats.write_off(v, f, str(tmp_path / "out"))
    (back,) = glob.glob(str(tmp_path / "out" / "model_id=b" / "part*"))
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "b.off").write_text(open(back).read())
    v2, f2 = formats.read_off(spark, str(tmp_path / "again"))
    key = lambda df: sorted(map(tuple, df.where("model_id = 'b'").collect()))
    assert key(v2) == key(v) and key(f2) == key(f)


def test_xyz_seg_sdff(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("1 2 3 0 0 1\n4 5 6 0 1 0\n7 8\n9 9 9 9 9 9\n")
    got = formats.read_xyz(spark, str(tmp_path / "m.xyz")).collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2, 3, 0, 0, -1), (4, 5, 6, 0, -1, 0)]
    turned = formats.read_xyz(spark, str(tmp_path / "m.xyz"), rotate=True).collect()
    assert tuple(turned[0])[2:5] == (1, 3, -2)
    (tmp_path / "m.seg").write_text("0\n10\n\n")
    assert [r.label for r in formats.read_seg(spark, str(tmp_path / "m.seg")).collect()] == [0, 10]
    (tmp_path / "m.sdff").write_text("0.5\n1e-3\n")
    assert [r.sdf for r in formats.read_sdff(spark, str(tmp_path / "m.sdff")).collect()] == [0.5, 0.001]


def test_features_round_trip(spark, tmp_path):
    rows = [("m", i, *[float(i) + k / 8 for k in range(27)], label) for i, label in enumerate((0, 10, None, 11))]
    df = spark.createDataFrame(rows, "model_id string, point_id int, " + ", ".join(f"{c} double" for c in learning.FEATURES) + ", part_label int")
    formats.write_features(df, str(tmp_path / "f"))
    got = formats.read_features(spark, str(tmp_path / "f")).orderBy("evqu00").collect()
    assert [r.part_label for r in got] == [0, 10, None] and got[1].sdf == 1 + 26 / 8


def test_predictions_symmetry_priors_candidates(spark, tmp_path):
    dist = spark.createDataFrame([("m", p, l, (l + 1) / 10) for p in range(3) for l in range(3)], "model_id string, point_id int, label int, prob double")
    formats.write_predictions(dist, str(tmp_path / "p"))
    got = formats.read_predictions(spark, str(tmp_path / "p"))
    assert sorted((r.label, r.prob) for r in got.collect()) == sorted((r.label, r.prob) for r in dist.collect())
    best = learning.best_label(dist).collect()
    assert {r.label for r in best} == {2}
    null = learning.with_null_label(dist)
    assert null.where("label = 3 AND prob = 0.1").count() == 3
    (tmp_path / "s.txt").write_text("1 2\n\n5 3 4\n")
    assert [tuple(r) for r in formats.read_symmetry(spark, str(tmp_path / "s.txt")).collect()] == [(0, 1, 1), (0, 2, 1), (2, 5, 5), (2, 3, 5), (2, 4, 5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "3.txt").write_text("2 1\n1 0 0\n0 1 0\n0 0 1\n1 2 3\n4 5 6\n7 8 9 10\n1 0 0\n0 1 0\n0 0 1\n5 6 7\n")
    (r,) = formats.read_candidates(spark, str(tmp_path / "c")).collect()
    assert (r.cand_id, r.label, r.cluster_no, r.trans, r.point_ids, len(r.axes)) == (3, 2, 1, [1, 2, 3], [5, 6, 7], 9)
    (tmp_path / "mean.txt").write_text("1 2\n0.5 0.25 1\n2 1\n1 2 3\n4 5 6\n")
    assert sorted((r.label1, r.label2, r.row, tuple(r["values"])) for r in formats.read_priors(spark, str(tmp_path / "mean.txt")).collect()) == [(1, 2, 0, (0.5, 0.25, 1)), (2, 1, 0, (1, 2, 3)), (2, 1, 1, (4, 5, 6))]


def test_ply_and_thin(spark, tmp_path):
    pts = spark.createDataFrame([("m", i, float(i), 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(5)], "model_id string, point_id int, x double, y double, z double, nx double, ny double, nz double")
    formats.write_ply(pts, str(tmp_path / "o"))
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "o" / "model_id=m" / "part*")))).splitlines()
    assert text[0] == "ply" and text[2] == "element vertex 5" and text[10] == "0.0 0.0 0.0 0.0 0.0 1.0" and len(text) == 15
    assert sorted(r.point_id for r in formats.thin(pts, 2.0).collect()) == [0, 2, 4]


def test_names_and_forest(spark):
    df = spark.createDataFrame([(r"C:\data\chairs\off\12.v.off",), ("/data/chairs/off/12.v.off",)], "p string")
    got = df.select(G.model_name(F.col("p")), G.model_name_with_class(F.col("p")), G.seg_path(F.col("p"))).collect()
    assert tuple(got[0]) == ("12", "chairs_12", r"C:\data\chairs\gt\12.v.seg") and tuple(got[1]) == ("12", "chairs_12", "/data/chairs/gt/12.v.seg")
    day = spark.sql("SELECT TIMESTAMP '2020-02-03 01:02:03.004' AS t").select(G.millis_of_day(F.col("t")).alias("ms")).collect()
    assert day[0].ms == ((1 * 60 + 2) * 60 + 3) * 1000 + 4
    pts = spark.createDataFrame([(0, i, float(i), 3 * (i > 50) + 2 if i % 9 else None) for i in range(100)], "model_id int, point_id int, x double, part_label int")
    model = learning.train(pts, ["x"], trees=5)
    dist = learning.distributions(model, pts)
    assert {r.label for r in dist.select("label").distinct().collect()} == {2, 5}
    right = learning.best_label(dist).join(pts, ["model_id", "point_id"]).where("part_label = label").count()
    assert right > 80
