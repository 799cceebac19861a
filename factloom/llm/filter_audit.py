"""How quality filters interact: what each removes after, before and beside the others.

Five filters can be applied in 120 orders of 5 steps, but what a step does depends only on the set of filters
applied before it and on the filter it applies: an edge of the lattice of subsets, of which there are 80. Documents
are reduced to their pattern of failed filters and counted by (part, pattern, labels), at most 128 counts a part;
each count contributes to the 80 edges, and the 600 steps of all orders look up their edge. A filter's share over
all orders weighs each edge by the number of orders that pass through it, |S|! (4 - |S|)!.

The filters (a document fails if): A it has under 200 words; B 100 * distinct words < 50 * words; C 100 * ASCII
capitals > 3 * code points; D it holds one of # $ % & * |; E its text is that of a smaller id anywhere in the table.

E needs no meeting of copies: equal texts share a SHA-256 digest, and rows are counted by (digest, part, labels)
with their smallest id before they are shuffled, so a text that fills a third of the table arrives as a few rows.

Defined cases: null texts count as empty; a null id is larger and smaller than none, so it never fails E, and has
no labels; rows that repeat an id and a text are not copies of each other; of several label rows of an id the
largest value counts, and null is 0; a null part is ''; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, text_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 200, 50, 3, "#$%&*|"
COPY = 1 << FILTERS.index("E")
_FEATURES = "id long, part string, mask int, digest binary"

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def failures(body: bytes, marks: re.Pattern) -> int:
    """The bits of the filters A to D that a UTF-8 text fails."""
    words = body.split()
    length = len(body) - _count(body, _CONTINUED)
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * _count(body, _CAPITALS) > CAPITALS_PERCENT * length) << 2
        | (marks.search(body) is not None) << 3
    )


def _count(body: bytes, some: bytes) -> int:
    return len(body) - len(body.translate(None, some))


def _features(batches):
    marks = re.compile(b"[" + re.escape(MARKS.encode()) + b"]")
    for batch in batches:
        bodies = [x.as_py() for x in batch.column(2).cast(pa.binary())]
        masks = np.array([failures(b, marks) for b in bodies], dtype=np.int32)
        digests = pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks), digests], names=["id", "part", "mask", "digest"])


def failure_patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and their labels."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("body"))
    rows = rows.mapInArrow(_features, _FEATURES).groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.coalesce(F.max(F.coalesce(F.col(a) == 1, F.lit(False))), F.lit(False)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.filter("id is not null").join(marked, "id", "left").select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    known = known.unionByName(rows.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("fresh", F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0))
    either = F.explode(F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    found = groups.select("part", "good", "toxic", either.alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part and lattice edge (`applied`, the filters applied before, as bits; `next`, the filter that
    follows, as a bit) with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    size = len(filters)
    every = [(sum(1 << i for i in chosen), 1 << f, factorial(k) * factorial(size - 1 - k)) for f in range(size) for k in range(size) for chosen in combinations([i for i in range(size) if i != f], k)]
    listed = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(w).cast("long").alias("orders")) for s, f, w in every])
    x = patterns.select("*", F.explode(listed).alias("e")).select("*", "e.*")
    fails = F.col("mask").bitwiseAND(F.col("next")) != 0
    gone = F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    counted = x.groupBy("part", "applied", "next", "orders").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("next")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next"))).drop("orders")


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, next): every step of every order, a path through the lattice; 600 rows."""
    paths = []
    for order in permutations(range(len(filters))):
        applied, name = 0, "".join(filters[i] for i in order)
        for k, f in enumerate(order):
            paths.append((name, k + 1, applied, 1 << f))
            applied |= 1 << f
    return spark.createDataFrame(paths, "filter_order string, step int, applied int, next int")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step, zeros included: part, filter_order, step and the counts of its edge."""
    found = edges(failure_patterns(docs, labels, id_col, text_col, part_col))
    return found.join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"]).drop("applied", "next")  # 600 rows
