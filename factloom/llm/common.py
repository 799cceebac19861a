"""What the training-data operators share: shared storage, written tables, id filters and components."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import bound_batches, fresh_dir

#: Bits of a fixed-size id filter: 8 MB whatever the input. A fuller filter only passes more rows on to the exact join behind it.
FILTER_BITS = 1 << 26

EDGES_A_FILE = 20_000


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    """The text with null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def bodies_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body) of documents, for Python workers, in bounded batches however long the texts are."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("body"))


def give_back() -> None:
    """Free memory that this process keeps for later goes back to the system, where the C library can do so: Python
    workers live on between tasks, and an executor's memory has the idle ones in it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class KeyFilter:
    """A Bloom filter of bounded size over a key column, built by a distributed bit_or and held as one array.

    It only prunes: what it passes is always confirmed by an exact join or count. With `hashed` the key is
    itself a mixed 64-bit hash whose bits serve as probes, so that numpy code can probe it as well.
    """

    PROBES = 2

    def __init__(self, keys: DataFrame, key: str, bits: int = FILTER_BITS, hashed: bool = False):
        self.bits, self.hashed, spark = bits, hashed, keys.sparkSession
        probes = F.explode(F.array(*[self._at(F.col(key), i) for i in range(self.PROBES)]))
        words = keys.select(probes.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        table = np.zeros(bits // 64, dtype=np.int64)
        got = words.toPandas()  # at most bits / 64 rows, whatever the input
        table[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
        self.held = spark.sparkContext.broadcast(table)

    def _at(self, key: Column, i: int) -> Column:
        if self.hashed:
            return F.shiftrightunsigned(key, 31 * i).bitwiseAND(F.lit(self.bits - 1))
        return F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.bits))

    def may_contain(self, key: Column) -> Column:
        held = self.held

        @F.arrow_udf("boolean")
        def probe(first: pa.Array, second: pa.Array) -> pa.Array:
            out = np.ones(len(first), dtype=bool)
            for p in (first, second):
                at = p.to_numpy(zero_copy_only=False)
                out &= ((held.value[at >> 6] >> (at & 63)) & 1).astype(bool)
            return pa.array(out)

        return probe(*[self._at(key, i) for i in range(self.PROBES)])

    def prober(self):
        """A picklable test of an array of hashes, for a `hashed` filter."""
        return HashProbe(self.held, self.bits)


class HashProbe:
    def __init__(self, held, bits: int):
        self.held, self.mask = held, np.uint64(bits - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for i in range(KeyFilter.PROBES):
            at = ((keys >> np.uint64(31 * i)) & self.mask).astype(np.int64)
            out &= ((self.held.value[at >> 6] >> (at & 63)) & 1).astype(bool)
        return out


def without_keys(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose key is not in `dropped` (one column `key`). Only rows that a fixed-size
    filter can't clear are shuffled for the exact anti join; the wide rest stays where it was read."""
    name = free_name(df, "doubt")
    marked = df.withColumn(name, KeyFilter(dropped, key).may_contain(F.col(key)))
    clear = marked.filter(~F.coalesce(name, F.lit(False))).drop(name)
    return clear.unionByName(marked.filter(F.col(name)).drop(name).join(dropped, key, "left_anti"))


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds over (a, b) edges, a written table.

    Returns (id_col, component) with the smallest reachable id, itself included. Each round is a grouped
    minimum, so no component ever meets in one task, and a round's edges are written before the next, in files
    of about EDGES_A_FILE. Rounds grow with the logarithm of the longest chain; an unfinished result is an error.
    """
    files = max(1, -(-edges.count() // EDGES_A_FILE))
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().coalesce(files), "edges")
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    state = mark(e)
    for _ in range(rounds):
        e = written(_small_star(_large_star(e)).coalesce(files), "edges")
        last, state = state, mark(e)
        if state == last:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = e.groupBy(F.col("b").alias(id_col)).agg(F.min("a").alias("component"))
    return nodes.select(id_col).join(roots, id_col, "left").select(id_col, F.coalesce("component", id_col).alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    own = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = own.groupBy("u").agg(F.min("v").alias("m"))
    linked = own.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    return linked.union(least.select(F.col("m"), F.col("u"))).distinct()
