"""Model intake: keeps the catalogue of a growing collection of model files.

    python jobs/model_intake.py FILES OUTPUT CHECKPOINT [--config jobs/model_intake.json]

Model files arrive as rows (id, path, content) in new Parquet files of FILES, a folder or a
pattern.  A run takes the files that no earlier run with this checkpoint took, and keeps
below OUTPUT:

    parts/class=.../batch=.../   what each micro-batch had of each model, a partition a batch
    catalogue/class=.../         a row a model: files, first and last id, lines, bytes, path of the last file
    lists/class=.../             those paths, one a line, sorted: the list that other actions start from

A model's class is the folder of its file, its name the file's up to the first dot.  A
batch that is done again replaces its own part and then computes the catalogue of its classes
from their parts, so neither a rerun nor a run after a failure counts anything twice.
Only parts and the catalogue of classes with new files are read and written again.
Queries and fragments of paths do not count; a null path or content is empty.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs import command
from pointloom.functions import geometry as G

LOG = logging.getLogger("model_intake")
DEFAULTS = {
    "id": "page_id", "path": "url", "content": "html",  # columns of the arriving files
    "files_a_batch": 100,
}
#: The class of files without a folder.
NO_CLASS = "-"
PART = "model string, name string, files long, first_id long, last_id long, lines long, bytes long, last struct<id:bigint,path:string>, class string, batch long"
ROW = "model string, name string, files long, first_id long, last_id long, lines long, bytes long, path string, seg string, class string"


def described(files: DataFrame, settings: dict) -> DataFrame:
    """id, path, class, model, name, lines and bytes of each file."""
    text = lambda c: F.coalesce(F.col(settings[c]), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(text("path"), r"(?s)[?#].*$", ""), r"/+$", "")
    own = files.select(F.col(settings["id"]).cast("long").alias("id"), path.alias("path"), text("content").alias("content"))
    folder = F.try_element_at(F.split("path", r"[/\\]"), F.lit(-2))
    lines = F.length("content") - F.length(F.translate("content", "\n", "")) + F.when(F.col("content") == "", 0).otherwise(1)
    return own.select(
        "id", "path", F.coalesce(F.nullif(folder, F.lit("")), F.lit(NO_CLASS)).alias("class"), G.model_name(F.col("path")).alias("model"), G.model_name_with_class(F.col("path")).alias("name"),
        lines.cast("long").alias("lines"), F.octet_length("content").cast("long").alias("bytes"),
    )


def _replace(df: DataFrame, schema: str, path: str, *by: str) -> None:
    """Writes the partitions that ``df`` has; a class's rows come together, in several tasks where they are many."""
    df = df.select(*StructType.fromDDL(schema).names).hint("rebalance", F.col("class"))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _last(id_, path):
    return F.max(F.struct(id_.alias("id"), path.alias("path"))).alias("last")


def take(batch: DataFrame, number: int, output: str, settings: dict) -> None:
    """Takes one micro-batch in; doing it again changes nothing."""
    spark = batch.sparkSession
    found = described(batch, settings).groupBy("class", "model").agg(
        F.min("name").alias("name"), F.count("*").alias("files"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), _last(F.col("id"), F.col("path"))
    )
    _replace(found.withColumn("batch", F.lit(number).cast("long")), PART, f"{output}/parts", "class", "batch")
    parts = spark.read.schema(PART).parquet(f"{output}/parts")
    classes = parts.where(F.col("batch") == number).select("class").distinct()
    own = parts.join(classes, "class", "left_semi").groupBy("class", "model").agg(
        F.min("name").alias("name"), F.sum("files").alias("files"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), _last(F.col("last.id"), F.col("last.path"))
    )
    own = own.withColumn("path", F.col("last.path")).withColumn("seg", G.seg_path(F.col("path")))
    _replace(own, ROW, f"{output}/catalogue", "class")
    catalogue = spark.read.schema(ROW).parquet(f"{output}/catalogue").join(classes, "class", "left_semi")
    lists = catalogue.select("class", F.col("path").alias("value"))
    lists.repartitionByRange("class", "value").sortWithinPartitions("class", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class").text(f"{output}/lists")
    n = parts.where(F.col("batch") == number).agg(F.sum("files"), F.count("*"), F.count_distinct("class")).collect()[0]
    LOG.info("batch %d: wrote %d files of %d models in %d classes", number, n[0] or 0, n[1], n[2])


def run(spark: SparkSession, files: str, output: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Takes in what is new below ``files`` and returns the catalogue as it stands."""
    settings = DEFAULTS | (settings or {})
    schema = f"`{settings['id']}` long, `{settings['path']}` string, `{settings['content']}` string"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(files)
    LOG.info("reading new files of %s, checkpoint %s", files, checkpoint)
    stream = (
        arriving.writeStream.queryName(f"model_intake_{uuid.uuid4().hex}")
        .foreachBatch(lambda batch, number: take(batch, number, output, settings))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    taken = sum(p["numInputRows"] for p in stream.recentProgress)
    out = spark.read.schema(ROW).parquet(f"{output}/catalogue")
    LOG.info("read %d new rows; %s has %d models", taken, f"{output}/catalogue", out.count())
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("files", "output", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=os.path.join(command.HERE, "model_intake.json"))
    args = parser.parse_args()
    with command.session("model_intake") as spark:
        run(spark, args.files, args.output, args.checkpoint, command.config(args.config, DEFAULTS))


if __name__ == "__main__":
    main()
