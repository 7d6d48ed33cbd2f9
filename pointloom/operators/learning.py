"""Point classification: random forest, label distributions, arg-max."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import NULL_PROB

#: The 27 features, in file order.
FEATURES = [c for s in range(5) for c in (f"evqu{s}0", f"evqu{s}1", f"grav{s}0", f"grav{s}1", f"curvature{s}")] + ["height", "sdf"]


def train(points: DataFrame, features=FEATURES, label: str = "part_label", trees: int = 100, seed: int = 7) -> PipelineModel:
    """Rows without a label or a feature are left out; labels may have gaps."""
    rows = points.where(F.col(label).isNotNull()).na.drop(subset=list(features))
    index = StringIndexer(inputCol=label, outputCol="__index", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="__index", featuresCol="__features", numTrees=trees, seed=seed)
    return Pipeline(stages=[index.setHandleInvalid("keep"), VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep"), forest]).fit(rows)


def distributions(model: PipelineModel, points: DataFrame, label_type: str = "int") -> DataFrame:
    """model_id, point_id, label, prob: one row a point and known label."""
    names = model.stages[0].labels
    scored = model.stages[2].transform(model.stages[1].transform(points))
    probs = scored.select("model_id", "point_id", F.posexplode(vector_to_array("probability")).alias("n", "prob"))
    known = F.array(*[F.lit(x) for x in names])
    return probs.where(F.col("n") < len(names)).select("model_id", "point_id", F.get(known, F.col("n")).cast(label_type).alias("label"), "prob")


def with_null_label(dist: DataFrame, prob: float = NULL_PROB) -> DataFrame:
    """Adds one row a point for the label after the last one."""
    last = dist.agg((F.max("label") + 1).cast(dict(dist.dtypes)["label"]).alias("label"))
    rows = dist.select("model_id", "point_id").distinct().join(F.broadcast(last)).select("model_id", "point_id", "label", F.lit(prob).cast(dict(dist.dtypes)["prob"]).alias("prob"))
    return dist.select("model_id", "point_id", "label", "prob").unionByName(rows)


def best_label(dist: DataFrame) -> DataFrame:
    """The likeliest label of each point, the lowest of equals."""
    return dist.groupBy("model_id", "point_id").agg(F.max_by("label", F.struct("prob", -F.col("label"))).alias("label"), F.max("prob").alias("prob"))
