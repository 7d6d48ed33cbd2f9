"""Quality rules: counts per document and a hashed n-gram log-likelihood ratio.

DataFrame functions only.  Two multinomials over hash buckets of token 1-grams and 2-grams
are counted, one over documents that labels call trusted, one over the whole corpus.  A
document's score is the mean, over its n-grams, of ``ln(p_trusted / p_corpus)``.  The
threshold is the point that best separates the labelled documents; every document gets a
verdict by comparing its score with it, so equal texts get equal verdicts.

Texts are split once: counts and buckets are written beside the rows, and all that follows
reads those.  No text is shuffled.  The trusted multinomial is fit on at most about
``MAX_TRUSTED`` trusted labels (those whose ids hash lowest), which are broadcast; corpus
counts, scores and the threshold cover everything.

Null texts have no words; documents without n-grams score 0; labels that are missing, null
or for unknown documents are ignored; repeated rows count once each.  With no trusted or no
rejected labels the threshold is ``-inf`` and only the base rules reject.  An empty table gives an empty
one.  ``judge`` reads doc_id and text alone; ``filtered`` hands other columns on, whatever their
names.  A text of any length is one row that is split whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
#: Trusted labels that the trusted multinomial is fit on, about: more are sampled by a hash of their ids.
MAX_TRUSTED = 200_000
#: Weight of a trusted document that is rejected against a bad one that is kept.
KEEP_WEIGHT = 10.0
#: The threshold is searched on a fixed grid, so that only its counts reach the driver.
GRID, LOW, HIGH = 4096, -8.0, 8.0

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Where a token ends: blanks, and between other characters and ASCII punctuation.
TOKEN_GAP = r"[\x20\x09-\x0D]+|(?<=[0-9A-Za-z\x{80}-\x{10FFFF}])(?=[!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9A-Za-z\x{80}-\x{10FFFF}])"
SYMBOLS = r"[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", words_of(F.col(text)))
    n = F.size("__words")
    df = df.withColumn(
        "__h",
        F.transform(
            F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        ),
    )
    # Only texts that repeat a window: (hash, place) sorted, so that equal windows are neighbours.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__sorted", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(
        F.transform("__sorted", lambda x, k: F.when((x["h"] == F.get("__sorted", k - 1)["h"]) | (x["h"] == F.get("__sorted", k + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    # Sorted starts of repeated windows: each covers three words, less what the next covers too.
    df = df.withColumn("__starts", F.when(F.col("__sorted").isNotNull(), F.sort_array(again)))
    covered = F.coalesce(F.aggregate("__starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"]), F.lit(0).cast("long"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": covered,
        }
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__words", "__h", "__sorted", "__starts")


def with_buckets(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``__grams``: hash buckets of all token 1-grams and 2-grams, repeats included."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKEN_GAP), lambda t: t != "")
    df = df.withColumn("__tokens", F.transform(tokens, lambda t: F.xxhash64(t)))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    ones = F.transform("__tokens", bucket)
    twos = F.transform(F.slice("__tokens", F.lit(2), F.greatest(F.size("__tokens") - 1, F.lit(0))), lambda b, i: bucket(F.xxhash64(F.get("__tokens", i), b)))
    return df.withColumn("__grams", F.concat(ones, twos)).drop("__tokens")


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """``__id`` and ``__trusted`` (1) of about ``most`` trusted documents at most."""
    ids = written(labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id")).distinct(), "trusted")
    n = ids.count()
    if n > most:
        ids = ids.where(F.pmod(F.xxhash64("__id"), F.lit(n)) < most)
    return ids.withColumn("__trusted", F.lit(1))


def log_ratios(counted: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MAX_TRUSTED) -> list[float]:
    """ln(p_trusted / p_corpus) of each bucket, add-one smoothed; ``buckets`` rows reach the driver.

    counted: ``__id`` and ``__grams`` of all documents.
    """
    rows = counted.select("__id", "__grams").join(F.broadcast(trusted_ids(labels, most)), "__id", "left")
    # Not explode(): its inferred size filter would be pushed below the split and inlined into every lambda.
    found = rows.select(F.explode_outer("__grams").alias("b"), "__trusted").where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("raw"), F.count("__trusted").alias("good"))
    raw, good = [1.0] * buckets, [1.0] * buckets
    for r in found.collect():
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    all_raw, all_good = sum(raw), sum(good)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw, strict=True)]


def llr_of(ratios: list[float]) -> Column:
    """The length-normalised log-likelihood ratio, from ``__grams``."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate("__grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(F.size("__grams") > 0, total / F.greatest(F.size("__grams"), F.lit(1))).otherwise(0.0)


def threshold(scored: DataFrame, labels: DataFrame, keep_weight: float = KEEP_WEIGHT) -> float:
    """The least costly cut between labelled good and bad documents that the base rules keep.

    Cost: ``keep_weight`` x share of good ones rejected + share of bad ones kept; of equally
    good cuts the middle one.  Searched on ``GRID`` fixed bins.
    """
    known = labels.where("quality IN (0, 1) AND (quality = 0 OR coalesce(toxic, 0) = 0) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = (HIGH - LOW) / GRID
    place = F.least(F.greatest(F.floor((F.col("llr") - LOW) / step), F.lit(0)), F.lit(GRID - 1)).cast("int")
    found = scored.where("NOT base_failed").select("doc_id", place.alias("bin")).join(known, "doc_id").groupBy("bin", "quality").count().collect()
    hist = {0: [0] * GRID, 1: [0] * GRID}
    for r in found:
        hist[r["quality"]][r["bin"]] += r["count"]
    n_bad, n_good = sum(hist[0]), sum(hist[1])
    if not n_bad or not n_good:
        return -math.inf
    costs, lost, kept = [], 0, n_bad
    for i in range(GRID + 1):  # cut at the lower edge of bin i
        costs.append(keep_weight * lost / n_good + kept / n_bad)
        if i < GRID:
            lost += hist[1][i]
            kept -= hist[0][i]
    least = min(costs)
    start = costs.index(least)
    end = start
    while end < GRID and costs[end + 1] == least:
        end += 1
    return LOW + step * ((start + end) // 2)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(docs: DataFrame, doc_id: str, text: str, buckets: int, whole: bool) -> DataFrame:
    """Written once: ``__id``, the base counts, base_failed, ``__grams`` and, if ``whole``, the row as ``__doc``."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")] if whole else []
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"), *more)
    return written(with_buckets(base_counts(rows, "__text"), "__text", buckets).drop("__text"), "counted")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, keep_weight: float = KEEP_WEIGHT, most: int = MAX_TRUSTED) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, llr, cut and kept."""
    counted = _counted(docs, doc_id, text, buckets, False)
    llr = llr_of(log_ratios(counted, labels, buckets, most))
    scored = written(counted.select(F.col("__id").alias("doc_id"), *COUNTS, "base_failed", llr.alias("llr")), "quality")
    cut = threshold(scored, labels, keep_weight)
    return scored.withColumn("cut", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("cut")))


def filtered(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, keep_weight: float = KEEP_WEIGHT, most: int = MAX_TRUSTED) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, all columns; each row by its own verdict, without a join."""
    counted = _counted(docs, doc_id, text, buckets, True)
    llr = llr_of(log_ratios(counted, labels, buckets, most))
    cut = threshold(counted.select(F.col("__id").alias("doc_id"), "base_failed", llr.alias("llr")), labels, keep_weight)
    return counted.where(~F.col("base_failed") & (llr >= cut)).select("__doc.*")
