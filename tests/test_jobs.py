"""The jobs: runs over growing input, reruns, failures half way, odd rows, and the command lines."""

import glob
import json
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import command, model_intake, queries, training_set

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FILES = "page_id long, url string, html string"


def catalogue(rows):
    """What the intake should know of rows (id, path, content)."""
    out = {}
    for i, path, content in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        path = re.sub(r"/+$", "", re.sub(r"(?s)[?#].*$", "", path or ""))
        parts = re.split(r"[/\\]", path)
        name = parts[-1].split(".")[0]
        key = (parts[-2] if len(parts) > 1 and parts[-2] else "-", name)
        full = f"{parts[-3]}_{name}" if len(parts) > 2 else name
        text = content or ""
        o = out.setdefault(key, {"name": full, "files": 0, "ids": [], "lines": 0, "bytes": 0})
        o["name"] = min(o["name"], full)
        o["files"] += 1
        o["ids"].append(i)
        o["lines"] += text.count("\n") + bool(text)
        o["bytes"] += len(text.encode())
        o["path"] = path
    return {k: (o["name"], o["files"], min(o["ids"], default=None), max(o["ids"], default=None), o["lines"], o["bytes"], o["path"]) for k, o in out.items()}


def known(df):
    rows = df.collect()
    out = {(r["class"], r["model"]): (r["name"], r["files"], r["first_id"], r["last_id"], r["lines"], r["bytes"], r["path"]) for r in rows}
    assert len(out) == len(rows)
    return out


def arrive(spark, rows, folder, name):
    spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(f"{folder}/{name}")


def stamps(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


FIRST = [(1, "/data/chair/a.off", "OFF\n1 2"), (2, "/data/chair/b.off", ""), (3, "/data/lamp/a.x.off", None), (4, None, "x"), (5, "c.off?v=1", "é\n")]
SECOND = [(6, "/old/chair/a.off#2", "OFF"), (7, "C:\\data\\sofa\\007.off", "OFF\n\n"), (7, "C:\\data\\sofa\\007.off", "OFF\n\n"), (8, "/data/chair/b.off/", "b")]


def test_intake_takes_only_what_is_new(spark, tmp_path):
    files, out, mark = (str(tmp_path / n) for n in ("files", "out", "mark"))
    arrive(spark, FIRST, files, "day=1")
    assert known(model_intake.run(spark, f"{files}/*", out, mark)) == catalogue(FIRST)
    before = stamps(f"{out}/parts")
    arrive(spark, SECOND, files, "day=2")
    untouched = stamps(f"{out}/catalogue/class=lamp")
    assert known(model_intake.run(spark, f"{files}/*", out, mark)) == catalogue(FIRST + SECOND)
    parts = spark.read.schema(model_intake.PART).parquet(f"{out}/parts")
    assert {r["batch"]: r["n"] for r in parts.groupBy("batch").agg(F.sum("files").alias("n")).collect()} == {0: len(FIRST), 1: len(SECOND)}
    assert before.items() <= stamps(f"{out}/parts").items()
    assert stamps(f"{out}/catalogue/class=lamp") == untouched
    now = stamps(out)
    assert known(model_intake.run(spark, f"{files}/*", out, mark)) == catalogue(FIRST + SECOND)
    assert stamps(out) == now
    lines = spark.read.text(f"{out}/lists/class=chair").collect()
    assert [r.value for r in lines] == ["/data/chair/b.off", "/old/chair/a.off"]


def test_intake_after_a_failure_counts_nothing_twice(spark, tmp_path, monkeypatch):
    files, out, mark = (str(tmp_path / n) for n in ("files", "out", "mark"))
    arrive(spark, FIRST, files, "day=1")
    model_intake.run(spark, f"{files}/*", out, mark)
    arrive(spark, SECOND, files, "day=2")
    replace = model_intake._replace

    def fails(df, schema, path, *by):
        if path.endswith("catalogue"):
            raise RuntimeError("lost")
        replace(df, schema, path, *by)

    monkeypatch.setattr(model_intake, "_replace", fails)
    with pytest.raises(Exception, match="lost"):
        model_intake.run(spark, f"{files}/*", out, mark)
    monkeypatch.undo()
    assert known(model_intake.run(spark, f"{files}/*", out, mark)) == catalogue(FIRST + SECOND)
    model_intake.take(spark.createDataFrame(SECOND, FILES), 1, out, model_intake.DEFAULTS)
    assert known(spark.read.schema(model_intake.ROW).parquet(f"{out}/catalogue")) == catalogue(FIRST + SECOND)


def test_intake_of_the_pages_in_several_batches_equals_one(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = str(tmp_path / "files")
    pages.select("page_id", "url", "html").repartition(5).write.parquet(files)
    want = catalogue([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert known(model_intake.run(spark, files, str(tmp_path / "a"), str(tmp_path / "am"), {"files_a_batch": 2})) == want
    assert known(queries.job2_model_intake(spark, sf_dir)) == want


def cloud(spark, sf_dir, path, models):
    """The embeddings of some of five models, a tenth of them without a label."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where((F.col("vec_id") % 5).isin(list(models)))
    raw.withColumn("label", F.when(F.col("vec_id") % 10 != 3, F.col("label"))).write.mode("overwrite").parquet(path)


def test_training_set_in_several_runs_and_again(spark, sf_dir, tmp_path):
    a, b, both, out, whole = (str(tmp_path / n) for n in ("a", "b", "both", "out", "whole"))
    cloud(spark, sf_dir, a, [0, 1])
    cloud(spark, sf_dir, b, [2, 3, 4])
    cloud(spark, sf_dir, both, range(5))
    rows = lambda df: sorted(map(tuple, df.drop("weight").select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.drop("weight").dtypes]).collect()), key=repr)
    first = rows(training_set.run(spark, a, out))
    assert {r[-1] for r in first} == {0, 1}
    old = stamps(f"{out}/points/model_id=1")
    second = training_set.run(spark, b, out)
    assert stamps(f"{out}/points/model_id=1") == old
    assert rows(second) == rows(training_set.run(spark, both, whole)) == rows(training_set.run(spark, both, whole))
    found = spark.read.parquet(f"{whole}/points")
    assert found.where("part_label IS NULL").count() == 0
    assert found.count() == spark.read.parquet(both).where("label IS NOT NULL").count()
    weights = {r["part_label"]: r["w"] for r in found.groupBy("part_label").agg(F.sum("weight").alias("w")).collect()}
    assert max(weights.values()) == pytest.approx(min(weights.values()))
    assert [r.value for r in spark.read.text(f"{whole}/labels").collect()] == [str(k) for k in sorted(weights)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_training_set_refuses_ids_used_twice_before_it_writes(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(20)
    raw.union(raw.limit(1)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="twice"):
        training_set.run(spark, str(tmp_path / "twice"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_settings_come_from_the_config_file(tmp_path):
    for job in (model_intake, training_set):
        name = job.__name__.split(".")[-1]
        assert command.config(os.path.join(ROOT, "jobs", f"{name}.json"), job.DEFAULTS) == job.DEFAULTS
    wrong = tmp_path / "wrong.json"
    wrong.write_text(json.dumps({"fles": 1}))
    with pytest.raises(ValueError, match="fles"):
        command.config(str(wrong), model_intake.DEFAULTS)


def test_command_line(spark, tmp_path):
    arrive(spark, FIRST, str(tmp_path / "files"), "day=1")
    run = [sys.executable, f"{ROOT}/jobs/model_intake.py", f"{tmp_path}/files/*", f"{tmp_path}/out", f"{tmp_path}/mark"]
    done = subprocess.run(run, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"read {len(FIRST)} new rows" in done.stderr
    assert known(spark.read.schema(model_intake.ROW).parquet(f"{tmp_path}/out/catalogue")) == catalogue(FIRST)
