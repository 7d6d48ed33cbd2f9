"""Small helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that ``join_checked`` sends to every executor.
BROADCAST_ROWS = 250_000

#: Characters that separate words, and that are stripped from lines (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may go without (tests): it gets a temporary one.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pointloom-"))
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pointloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, small: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join a written table: broadcast if a count shows at most ``rows`` rows (``BROADCAST_ROWS``), else by shuffle.

    ``small`` must be narrow (keys and numbers), so that ``rows`` bounds its bytes.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    few = small.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(small) if few else small.hint("merge"), on, how)


#: Keys that ``join_counted`` takes out of the shuffle, at most.
HOT_KEYS = 50_000


def join_counted(left: DataFrame, small: DataFrame, on: list[str], how: str, count: str, rows: int | None = None) -> DataFrame:
    """``join_checked``, inner or left, for a written table with a row a key and how many rows of ``left`` have it.

    Beyond the size for a broadcast, keys that more than one in ``HOT_KEYS`` of those rows
    have (so fewer than ``HOT_KEYS`` keys) are broadcast by themselves, so that no key is met
    by many rows in one task.
    """
    if small.limit((BROADCAST_ROWS if rows is None else rows) + 1).count() <= (BROADCAST_ROWS if rows is None else rows):
        return left.join(F.broadcast(small.drop(count)), on, how)
    total = small.agg(F.sum(count)).collect()[0][0]
    is_hot = F.col(count) > total / HOT_KEYS
    hot = F.broadcast(small.where(is_hot).drop(count).withColumn("__hot", F.lit(True)))
    rest = small.where(~is_hot).drop(count)
    met = left.join(hot, on, "left")
    cool = left.join(hot, on, "left_anti").join(rest.hint("merge"), on, how)
    return met.where("__hot").drop("__hot").unionByName(cool)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)
