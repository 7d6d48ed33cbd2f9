"""Training set: features of all labelled points of a collection of models.

    python jobs/training_set.py POINTS OUTPUT [--config jobs/training_set.json]

Reads a table of points (id, vector, label), computes each point's 27 features among all
points of its model, labelled or not, drops points without a label, weights the classes and
writes Parquet below OUTPUT:

    points/model_id=.../     features, part_label and weight, a partition a model
    labels/                  the labels in use, sorted, one a line

A run replaces the partitions of the models it read and leaves other models' alone, so it
can be repeated, and a collection can be done in several runs.  ``weight`` makes all labels
of a run count alike: rows / (labels * rows of the label).  Points without an id or a whole
place are left out; an id that occurs twice, or a model that has lost all its labels since it
was written, is an error.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import command
from pointloom.operators import spatial

LOG = logging.getLogger("training_set")
DEFAULTS = {
    "id": "vec_id", "vector": "embedding", "label": "label",  # columns of the points table
    "models": 5,  # a point belongs to model id modulo models
    "radius": 1.0,  # of a model; neighbourhoods are parts of it
    "cone": 30.0,  # degrees around the inward normal in which a shape diameter looks
}


def points_of(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """model_id, point_id, place, unit normal and part_label; points without a whole place are left out."""
    numbers = F.transform(settings["vector"], lambda v: v.cast("double"))
    raw = spark.read.parquet(path).select(F.col(settings["id"]).alias("point_id"), F.col(settings["label"]).cast("int").alias("part_label"), numbers.alias("v"))
    at = [F.get("v", F.lit(i)) for i in range(6)]
    size = F.nullif(F.sqrt(at[3] * at[3] + at[4] * at[4] + at[5] * at[5]), F.lit(0.0))
    out = raw.select(
        F.pmod("point_id", F.lit(settings["models"])).cast("int").alias("model_id"), "point_id", *[at[i].alias(c) for i, c in enumerate("xyz")], *[(at[i + 3] / size).alias(f"n{c}") for i, c in enumerate("xyz")], "part_label"
    )
    return out.where("point_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def run(spark: SparkSession, points_path: str, output: str, settings: dict | None = None) -> DataFrame:
    """Writes the training set below ``output`` and returns it as it stands there."""
    settings = DEFAULTS | (settings or {})
    points = points_of(spark, points_path, settings)
    LOG.info("reading points from %s", points_path)
    of_model = points.groupBy("model_id").agg(F.count("*").alias("n"), F.count("part_label").alias("labelled"), F.count_distinct("point_id").alias("ids"))
    read = {r["model_id"]: r for r in of_model.collect()}
    LOG.info("read %d points of %d models, %d with a label", sum(r["n"] for r in read.values()), len(read), sum(r["labelled"] for r in read.values()))
    if twice := sorted(m for m, r in read.items() if r["ids"] < r["n"]):
        raise ValueError(f"models that use a point's id twice: {twice}")
    keys = ["model_id", "point_id"]
    features = spatial.multiscale(points, settings["radius"]).join(spatial.point_sdf(points, settings["cone"]), keys)
    labelled = points.where("part_label IS NOT NULL")
    counts = labelled.groupBy("part_label").agg(F.count("*").alias("own"))
    rows, labels = labelled.agg(F.count("*"), F.count_distinct("part_label")).collect()[0]
    weights = counts.select("part_label", (F.lit(float(rows)) / (F.lit(labels) * F.col("own"))).alias("weight"))
    ready = features.join(labelled.select(*keys, F.col("y").alias("height"), "part_label"), keys).join(weights, "part_label")
    ready = ready.select("point_id", *[c for c in features.columns if c not in keys], "height", "part_label", "weight", "model_id")
    # A partition's rows come together, in several tasks where they are many.
    ready.hint("rebalance", F.col("model_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{output}/points")
    out = spark.read.schema(ready.schema).parquet(f"{output}/points")
    names = out.select("part_label").distinct().orderBy("part_label")
    names.select(F.col("part_label").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{output}/labels")
    now = {r["model_id"]: r["count"] for r in out.groupBy("model_id").count().collect()}
    LOG.info("wrote %d rows of %d models below %s", sum(now.get(m, 0) for m in read), len(read), output)
    if wrong := {m: (r["labelled"], now.get(m, 0)) for m, r in read.items() if r["labelled"] != now.get(m, 0)}:
        raise RuntimeError(f"models whose labelled points are not those written: {wrong}")
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("points")
    parser.add_argument("output")
    parser.add_argument("--config", default=os.path.join(command.HERE, "training_set.json"))
    args = parser.parse_args()
    with command.session("training_set") as spark:
        run(spark, args.points, args.output, command.config(args.config, DEFAULTS))


if __name__ == "__main__":
    main()
