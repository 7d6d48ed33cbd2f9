"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the 128-bit hash of a line's key, one row a key:
in how many documents the run's batch holds it, and the key's owner if the key was new
when the batch came.  Each batch merge-anti-joins the runs to find its new keys and adds a
run of its own at level 0; when a level has ``fanout`` runs they are merged into one run of
the next level.  Batches are slices of the documents in descending order of doc_id, of about
equally many lines each, so a key's owner is the largest doc_id that holds it.

Keys of ``min_chars`` code points or more found in ``min_docs`` documents or more lose all
their lines but the owner's.  A null or empty text is one empty line.  Rows that repeat a
doc_id count as one document and lose the same lines by key; a null doc_id counts as one
document below all others.  Very common lines meet only as one partial sum a task, and find their
documents by a broadcast of the few such keys.  Texts of any length are split whole.  An empty
table gives an empty one.  ``dedup`` reads doc_id and text alone; ``replaced`` hands other
columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import BLANKS, BROADCAST_ROWS, ascii_lower, join_checked, join_counted, scratch, written

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2


class LineRuns:
    """The levels of runs, kept as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _save(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", scratch(self.spark, "run")).format("parquet").saveAsTable(name)
        return name

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def merged(self, names: list[str]) -> DataFrame:
        """Runs merged by their sorted keys: bucketed alike, they are not shuffled again."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnsRenamed({"n_docs": "n2", "owner": "owner2"}).hint("merge")
            both = out.join(other, ["h1", "h2"], "full_outer")
            out = both.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("owner", "owner2").alias("owner"))
        return out

    def add(self, lines: DataFrame) -> None:
        """A batch with columns h1, h2, doc_id; no other batch may hold its documents."""
        own = lines.groupBy("h1", "h2").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("n_docs"), F.max("doc_id").alias("owner"))
        if self.names():  # keys that some run has only add to its count
            fresh = own.select("h1", "h2", F.lit(True).alias("is_new"))
            for name in self.names():
                fresh = fresh.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            own = own.join(fresh, ["h1", "h2"], "left").select("h1", "h2", "n_docs", F.when(F.col("is_new"), F.col("owner")).alias("owner"))
        self._put(0, self._save(own))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._save(self.merged(runs))
            for old in runs:
                self._forget(old)
            self._put(level + 1, merged)

    def _forget(self, name: str) -> None:
        """Drops the catalog's entry; the files stay for plans that still read them."""
        self.spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        for name in self.names():
            self._forget(name)
        self.levels = []


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (hash of the text), place, h1, h2 of every line whose key is long enough."""
    body = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(body).alias("row"), F.posexplode(F.split(body, "\n", -1)).alias("place", "line"))
    keys = lines.select("doc_id", "row", "place", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _kept(text: str | None, drop) -> tuple[int, str]:
    """How many lines the text has, and the text without those at some places."""
    lines, gone = (text or "").split("\n"), set(drop or ())
    return len(lines), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or ""


def _cut(batches):
    for batch in batches:
        ids, texts, drops = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for text, drop in zip(texts, drops, strict=True):
            n, kept = _kept(text, drop)
            rows.append((n, len(drop or ()), kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        n, d, k, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.string()), pa.array(s, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, row (hash of the text) and ``__drop``, the places of its lines that go; documents that lose none are absent."""
    spark = docs.sparkSession
    lines = written(line_hashes(docs, min_chars), "lines")
    # Where batches end decides how much each holds, and nothing else: an approximate quantile will do.
    ends = lines.agg(F.percentile_approx("doc_id", [b / batches for b in range(1, batches)] or [0.5], 1000)).collect()[0][0] or []
    edges = [None, *sorted(set(ends[: batches - 1])), None]
    runs = LineRuns(spark, fanout=fanout)
    for low, high in reversed(list(itertools.pairwise(edges))):
        inside = F.lit(True) if high is None else F.col("doc_id") <= high
        inside = (inside & (F.col("doc_id") > low)) if low is not None else inside | F.col("doc_id").isNull()
        runs.add(lines.where(inside))
    common = runs.merged(runs.names()).where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner", "n_docs")
    hit = join_counted(lines, written(common, "common"), ["h1", "h2"], "inner", "n_docs").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    out = written(hit.groupBy("doc_id", "row").agg(F.collect_set("place").alias("__drop")), "drops")
    runs.drop()
    return out


def _with_drops(docs: DataFrame, own: DataFrame, *rules) -> DataFrame:
    """``own`` (doc_id, text and more) with ``__drop``, the places of lines that go."""
    gone = drops(docs, *rules).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__drop")
    same = own["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(F.coalesce(own["text"], F.lit(""))) == gone["__row"])
    # A list of places may be long: only few documents may be broadcast.
    return join_checked(own, gone, same, "left", BROADCAST_ROWS // 25)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept (the text left), kept_sha256."""
    docs = docs.select("doc_id", "text")
    joined = _with_drops(docs, docs, min_chars, min_docs, batches, fanout)
    return joined.select("doc_id", "text", "__drop").mapInArrow(_cut, "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def _replace(batches):
    for batch in batches:
        texts = [_kept(t, d)[1] if d else t for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "__rest"])


def replaced(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with all its columns, texts without the lines that go, ``n_chars`` (if there) to match."""
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"))
    joined = _with_drops(docs.select("doc_id", "text"), own, min_chars, min_docs, batches, fanout)
    out = joined.select("text", "__drop", "__rest").mapInArrow(_replace, StructType([StructField("text", StringType()), own.schema["__rest"]]))
    size = lambda c: F.char_length("text").cast(docs.schema[c].dataType).alias(c)
    return out.select(*[F.col("text") if c == "text" else size(c) if c == "n_chars" else F.col(f"__rest.`{c}`") for c in docs.columns])
