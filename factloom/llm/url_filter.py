"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Listed rules are keys `host + path`. A url's candidate keys are its host's label suffixes joined with its
path's prefixes, taken only at the (label count, path length) shapes that occur in the list. The complete
universe of candidate keys of the corpus is gathered once; the cascade then alternates: level 0 encodes the
listed keys, level 1 the universe's keys that level 0 passes wrongly, level 2 the listed keys that level 1
passes, and so on until a level passes nothing wrongly. Over that universe membership is exact, and each url
is judged by bit tests alone: no join, no shuffle of urls.

Level sizes follow the list, not the corpus: level 0 gets so many bits that about as many keys of the
universe pass it wrongly as are listed. `max_filter_bytes` checks that size; a longer list is matched by a
shuffled join on the same candidate keys, with the same result.

Defined cases: a null url or one without `://` has empty host and path; repeated urls are judged alike; of
rules that fit, the longest key wins (a host and path make one key only one way, so there are no ties);
where no rule fits, rule is null and the verdict is `default`; no rules or an empty table are allowed;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written

PROBES = 3
MAX_FILTER_BYTES = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _shape(rule: str) -> tuple[int, int]:
    host, slash, path = rule.partition("/")
    return host.count(".") + 1, len(slash + path)


def _candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """The url's key of each shape; null where it has too few labels or too short a path."""
    labels = F.split(host, r"\.")
    return [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= p) & (F.length(host) > 0),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, p)),
        )
        for n, p in shapes
    ]


class BloomCascade:
    """Exact membership of `listed` over `universe` (both one column `key`) as levels of bit arrays."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES):
        self.levels: list[np.ndarray] = []
        self.fits = True
        inside = listed.select("key").distinct()
        n, u = inside.count(), universe.count()
        outside = universe.join(inside, "key", "left_anti").select("key")
        while n:
            rate = max(1.0, math.log2(max(2, u / n))) if not self.levels else 4.0
            size = 64 * math.ceil(max(64.0, n * rate * 1.6 + 8 * n) / 64)
            if sum(x.nbytes for x in self.levels) + size // 8 > max_bytes:
                self.fits = False
                return
            self.levels.append(self._level(inside, size, len(self.levels)))
            wrong = written(outside.filter(self._passes(len(self.levels) - 1, F.col("key"))), "cascade")
            inside, outside = wrong, inside
            n = inside.count()

    @staticmethod
    def _at(level: int, i: int, size: int, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(size))

    def _level(self, keys: DataFrame, size: int, level: int) -> np.ndarray:
        at = F.explode(F.array(*[self._at(level, i, size, F.col("key")) for i in range(PROBES)]))
        words = keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        bits = np.zeros(size // 64, dtype=np.int64)
        for row in words.collect():  # at most size / 64 rows, checked against max_bytes
            bits[row["w"]] = row["v"]
        return bits

    def _passes(self, level: int, key: Column) -> Column:
        bits = self.levels[level]
        held, out = F.lit(bits), F.lit(True)
        for i in range(PROBES):
            p = self._at(level, i, 64 * len(bits), key)
            out &= F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        return out

    def contains(self, key: Column) -> Column:
        """True or false for any key of the universe, and null for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(level, key), out).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNotNull(), out)


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """id, host, path, rule and verdict of each url. `rules` are (action, host + path) with action 'allow' or 'block';
    a rule fits its host and all subdomains where the url's path starts with the rule's."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    shapes = sorted({_shape(r) for _, r in rules})
    if not shapes:
        return parsed.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = _candidates(F.col("host"), F.col("path"), shapes)
    universe = written(parsed.select(F.explode(F.array(*keys)).alias("key")).filter("key is not null").distinct(), "urls")
    every = spark.createDataFrame([(r, a) for a, r in rules], "key string, action string").dropDuplicates(["key"])
    listed = BloomCascade(every, universe, max_filter_bytes)
    blocked = BloomCascade(every.filter("action = 'block'"), universe, max_filter_bytes)
    if not (listed.fits and blocked.fits):
        return _by_join(parsed, keys, every, id_col, default)
    fitting = F.greatest(*[F.when(listed.contains(k), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in keys], F.lit(None))
    named = parsed.withColumn("rule", fitting["key"])
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return named.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def _by_join(parsed: DataFrame, keys: list[Column], every: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same verdicts for a list over the size bound: distinct candidate keys meet the list in a shuffled join."""
    rows = written(parsed.withColumn("row", F.monotonically_increasing_id()), "rows")
    pairs = rows.select("row", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    best = pairs.join(every, "key").groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("b"))
    return rows.join(best, "row", "left").select(id_col, "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))
