"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept, is written as Parquet and read again.
All but the last return the columns of ``documents``.

Stages judge rows, not ids.  Rows that repeat a doc_id, or have none, are judged by their own
texts; rows that repeat a doc_id and its text are one document with copies, of which the
near-duplicate stage keeps one.  A null text is an empty one: the quality rules reject it, as
they do all texts of fewer than 50 words; a stage run by itself keeps it (near duplicates: one
of all texts without words) and packing makes it a single end token.  Equal texts get equal
verdicts.  Texts are read whole, whatever their length.  Empty tables give empty results; no
labels mean that only the base rules reject, no benchmark that nothing is contaminated.  Other
columns pass through, whatever their names, save that n_chars follows a text that loses lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import decontaminate, line_dedup, packing, quality, simhash
from pointloom.llm.common import join_checked, scratch, written
from pointloom.llm.queries import table, tokenizer_path


#: Share of five-word shingles that two texts must have in common to be near copies.
NEAR_SIMILARITY = 0.8


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Joins ``docs`` with distinct doc_id (null included) and text_hash of ``rows``: an id alone names no row."""
    own = written(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "rows")
    same = docs["doc_id"].eqNullSafe(own["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == own["__hash"])
    return join_checked(docs, own, same, how)


def _but(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are not among ``rows``."""
    return _among(docs, rows, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in one document; texts without them replace the old ones."""
    return line_dedup.replaced(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id.

    Texts are near copies if their SimHash fingerprints differ in at most three bits.  Those find
    few of the copies that share 0.8 of their shingles; so such pairs are links too: candidates
    come from MinHash bands, which miss one of 10,000 of them, and their shingles are checked.
    """
    found = written(simhash.near_rows(docs, NEAR_SIMILARITY), "near")
    left = _but(docs, found.where("NOT first"))
    again = written(found.where("first").groupBy("doc_id", "text_hash").count().where("count > 1"), "again")
    if again.isEmpty():
        return left
    # Few rows: one of each id and text, whatever columns there are.
    twice = _among(left, again, "left_semi").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = twice.dropDuplicates(["doc_id", "hash"]).select("row.*")
    return _but(left, again).unionByName(once)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", pack),
]

#: Hashed likelihood ratios, SimHash and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
