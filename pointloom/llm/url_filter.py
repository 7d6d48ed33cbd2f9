"""URL rules through a cascade of Bloom filters, in DataFrame functions only.

Level 1 encodes the listed keys, level 2 those keys of the corpus that level 1 takes for
listed though they are not, level 3 the listed keys that level 2 holds, and so on until a
level makes no mistake.  Over the keys the levels were built from membership is exact, and
asking needs no join: the levels are constants of the expression.  Which of the listed keys
block is asked of a second cascade, over the listed keys alone.

Constants of a plan must stay small: a list whose cascades would need over ``MAX_BITS`` bits is
met by a shuffled join of the asked keys instead, with equal results.

A key is ``host suffix + path prefix``.  A url asks for every suffix of its host (whole
labels) with every prefix length that occurs among the rules.

Nulls and urls without ``://`` have an empty host and path and fit no rule; an empty rule
list allows everything; repeated rows are judged one by one.  Columns named host, path, rule or
verdict are replaced; others may have any name.  A url of any length is read whole; it asks for
as many keys as its host has labels times the prefix lengths of the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Bits of a level that a plan may carry (512 KiB): about 290,000 rules at the default rate.
MAX_BITS = 1 << 22
#: Level 1 wrongly takes this share of the corpus's keys for listed; later levels half.
FIRST_RATE, NEXT_RATE = 1e-3, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, and how it is probed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether every probed bit is set."""
        # One foldable expression, named once: the optimizer turns it into a single array constant.
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        places = F.array(*positions(key, self.seed, self.hashes, len(self.words) * 64))
        return F.forall(places, lambda at: F.getbit(F.get(table, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)


def positions(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: bit positions from two 64-bit hashes of the key."""
    one = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits))
    two = F.pmod(F.xxhash64(F.lit(seed + 1_000_003), key), F.lit(bits))
    return [F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)]


def words_for(n: int, rate: float) -> int:
    return max(1, math.ceil(max(n, 1) * -math.log(rate) / math.log(2) ** 2 / 64))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A level over the ``n`` keys in column ``key``; only its words reach the driver."""
    size = words_for(n, rate)
    hashes = max(1, round(size * 64 / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 16)
    words = [0] * size
    pos = F.explode(F.array(*positions(F.col("key"), seed, hashes, size * 64)))
    filled = keys.select(pos.alias("pos")).groupBy(F.floor(F.col("pos") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("bits"))
    for row in filled.collect():  # at most ``size`` rows
        words[row["w"]] = row["bits"]
    return Level(tuple(words), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = FIRST_RATE, next_rate: float = NEXT_RATE) -> Cascade:
    """``listed`` and ``universe``: one column ``key``, repeats allowed.

    The universe is scanned once, through level 1, before anything is shuffled; later
    levels see only the listed keys and what level 1 got wrong (``first_rate`` of the
    universe's distinct keys).  Level i answers "listed" if i is odd; a key that passes
    all levels is of the kind the last one encodes.
    """
    listed = written(listed.where("key IS NOT NULL").distinct(), "listed")
    inside, outside = listed, None
    levels: list[Level] = []
    while True:
        seed = 7919 * (len(levels) + 1)
        level = build_level(inside, inside.count(), next_rate if levels else first_rate, seed)
        levels.append(level)
        if outside is None:
            taken = universe.where(F.col("key").isNotNull() & level.holds(F.col("key"))).distinct()
            wrong = taken.join(listed, "key", "left_anti")
        else:
            wrong = outside.where(level.holds(F.col("key")))
        wrong = written(wrong, "wrong")
        if wrong.isEmpty():
            return Cascade(tuple(levels))
        inside, outside = wrong, inside


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": ascii_lower(F.regexp_extract(text, pattern, 1)), "path": F.regexp_extract(text, pattern, 2)})


def asked_keys(rules: list[Rule]) -> Column:
    """Array of all keys a url may fit, longest first (over ``host`` and ``path``)."""
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    prefixes = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, p))))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", first_rate: float = FIRST_RATE, next_rate: float = NEXT_RATE) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``df``.

    The longest fitting rule decides (of rules with one key: block before allow); without
    one the cascade finds none of the url's keys listed and the verdict is ``default``.
    """
    df = with_parts(df.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]), url)
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    spark = df.sparkSession
    first = {r.key: r.verdict for r in sorted(rules, key=lambda r: r.verdict)}  # the last one stays
    listed = spark.createDataFrame(list(first.items()), "key string, verdict string")
    if 64 * words_for(len(first), first_rate) > MAX_BITS:
        return _joined(df, written(listed, "rules"), rules, default)
    universe = df.select("host", "path").select(F.explode(asked_keys(rules)).alias("key"))
    cascade = build_cascade(listed.select("key"), universe, first_rate, next_rate)
    df = df.withColumn("rule", F.get(F.filter(asked_keys(rules), cascade.contains), F.lit(0)))
    *others, last = sorted(set(first.values()))
    verdict = F.lit(last)
    for name in reversed(others):
        own = build_cascade(listed.where(F.col("verdict") == name).select("key"), listed.select("key"), first_rate, next_rate)
        verdict = F.when(own.contains(F.col("rule")), name).otherwise(verdict)
    return df.withColumn("verdict", F.when(F.col("rule").isNull(), default).otherwise(verdict))


def _joined(df: DataFrame, listed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The longest listed key (of equally long ones the first) of each distinct host and path, by a join of their asked keys."""
    places = written(df.select("host", "path").distinct(), "places")
    asked = places.select("host", "path", F.explode(asked_keys(rules)).alias("key"))
    met = asked.join(listed.hint("merge"), "key").groupBy("host", "path").agg(F.min_by(F.struct("key", "verdict"), F.struct(-F.char_length("key"), F.col("key"))).alias("best"))
    out = df.join(met.hint("merge"), ["host", "path"], "left")
    return out.select(*df.columns, F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
