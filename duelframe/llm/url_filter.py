"""URL verdicts by a Bloom filter cascade over the corpus's own keys.

Listed keys are hosts with path prefixes (`org/`, `example.org/en/1`: rules for a host and its
subdomains) and words of host names (a block list). The key universe is every key that some url of the
corpus has: each host suffix with each path prefix of a listed length, and each word of its host. The
first filter holds the listed keys; the second holds the other keys of the universe that pass the first;
the third the listed keys that pass the second; and so on, until no key passes wrongly. A key is listed
if the first level that it fails is an even one. Over the universe this is exact, so urls are judged
without joins: the cascade's bits go to every task. A level has log2(1 / rate) hashes, the best number for its
size, and the first one's rate is listed / universe: about as many other keys as are listed pass it and are
collected, however large the corpus is. So n listed keys among u take about 1.44 n log2(u / n) bits there and a
few n bits in all later levels.

The longest rule that fits a url decides; otherwise a listed word of its host blocks it, and everything
else is allowed. Null urls and urls without `://` have an empty host and path, fit no rule and are
allowed; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.session import cut_lineage

from .tokens import U, mix

#: (verdict, host, path) of the default rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of host names that block a url without a rule.
WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "lottery", "pills", "porn", "poker", "spam", "xxx")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url: each `host suffix` + `path prefix`, and `:word` for the words of the host."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    words = F.transform(F.split(host, r"[.-]"), lambda w: F.concat(F.lit(":"), w))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(rules, words)))


class Level:
    """One Bloom filter; `rate` is its share of wrong passes."""

    def __init__(self, number: int, keys: np.ndarray, rate: float):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros(self.size, dtype=bool)
        for i in range(self.hashes):
            self.bits[self._cells(keys, i)] = True

    def _cells(self, keys: np.ndarray, i: int) -> np.ndarray:
        return (mix(keys + U((self.number * 64 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(self.size)).astype(np.int64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        going = np.arange(len(keys))        # the keys that passed all hashes so far
        for i in range(self.hashes):
            going = going[self.bits[self._cells(keys[going], i)]]
        out = np.zeros(len(keys), dtype=bool)
        out[going] = True
        return out


def member(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Listed or not, exact for keys of the universe: the first level that a key fails decides."""
    out, going = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
    for level in levels:
        passed = level.passes(keys)
        out[going & ~passed] = level.number % 2 == 1
        going &= passed
    out[going] = len(levels) % 2 == 1
    return out


def _wrong(level: Level):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[level.passes(keys)].view(np.int64))], names=["key"])
    return run


def build(universe: DataFrame, listed: list[str]) -> list[Level]:
    """The cascade of the listed keys over `universe(key)`: hashes of all keys of the corpus, each once."""
    spark = universe.sparkSession
    own = spark.createDataFrame([(k,) for k in sorted(set(listed))], "name string").select(F.xxhash64("name").alias("key"))
    yes = np.array([r["key"] for r in own.join(universe, "key", "left_semi").collect()], dtype=np.int64).view(np.uint64)
    others = universe.join(F.broadcast(own), "key", "left_anti")      # as long as the list, which the caller holds in memory
    rate = min(0.5, max(1, len(yes)) / max(1, universe.count()))
    levels = [Level(0, yes, rate)]
    no = np.array([r["key"] for r in others.mapInArrow(_wrong(levels[0]), "key long").collect()], dtype=np.int64).view(np.uint64)
    wrong, right = no, yes
    while len(wrong):       # wrong passes of the last level, and the keys that it should hold
        levels.append(Level(len(levels), wrong, 0.5))
        wrong, right = right[levels[-1].passes(right)], wrong
    return levels


def _judge(sent):
    def run(batches):
        for batch in batches:
            hashes = batch.column("hashes")
            flat = member(sent.value, hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            names, at, out = batch.column("keys").to_pylist(), 0, []
            for row, size in zip(names, sizes):
                out.append([k for k, yes in zip(row, flat[at:at + size]) if yes])
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(out, pa.list_(pa.string()))], names=["page_id", "host", "path", "listed"])
    return run


def judge(pages: DataFrame, rules=RULES, words=WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page."""
    lengths = sorted({len(path) for _, _, path in rules})
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths)).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    universe = cut_lineage(keyed.select(F.explode("hashes").alias("key")).distinct(), "keys")
    levels = build(universe, [h + p for _, h, p in rules] + [":" + w for w in words])
    judged = keyed.mapInArrow(_judge(pages.sparkSession.sparkContext.broadcast(levels)), "page_id long, host string, path string, listed array<string>")
    fitting = F.filter("listed", lambda k: ~k.startswith(":"))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    says = F.coalesce(*[F.when(F.col("rule") == h + p, v) for v, h, p in rules]) if rules else F.lit(None).cast("string")
    return (judged.withColumn("rule", longest)
            .select("page_id", "host", "path", "rule", F.coalesce(says, F.when(F.size("listed") > 0, "block").otherwise("allow")).alias("verdict")))
