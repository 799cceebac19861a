"""Cosine top-k for tables of queries, exactly in blocks or through a stored index of coarse cells.

Vectors that are null or empty, hold null or non-finite components, or have no length, take no part. Similarities are
rounded to nine decimals and ties go to the smaller key, so a ranking does not depend on the order of addition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import fresh_dir

# Fixed value of the search contract: the results shown.
TOP = 8
#: Vectors of a block and queries of a block: what one task compares at once.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Vectors that cells are fitted on, cells at most, and recall that tuning looks for over so many queries.
SAMPLE, MOST_CELLS, RECALL, TUNING = 50_000, 1024, 0.95, 256
DECIMALS = 9


def fit(embedding: Column) -> Column:
    """Whether a vector takes part."""
    v = embedding.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(df: DataFrame, key: str, embedding: str, document: str | None) -> DataFrame:
    doc = F.col(document) if document else F.lit(0)
    return df.filter(fit(F.col(embedding))).select(doc.alias("doc"), F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("v"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: what follows plans a scan instead of all that made it."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    m = held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best_of_block(top: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        keys, asked = chunks["k"], queries["q"]
        if not len(keys) or not len(asked):
            return pa.table({"q": asked.slice(0, 0), "k": keys.slice(0, 0), "similarity": pa.array([], pa.float64())})
        order = np.argsort(np.argsort(keys.to_numpy(), kind="stable"), kind="stable")  # keys by rank, of any type
        near = np.round(_unit(queries["v"]) @ _unit(chunks["v"]).T, DECIMALS)
        rows, picks = [], []
        for i, row in enumerate(near):
            least = np.partition(row, -top)[-top] if len(row) > top else -np.inf
            found = np.flatnonzero(row >= least)  # with every tie at the last place
            found = found[np.lexsort((order[found], -row[found]))][:top]
            rows.append(np.full(len(found), i))
            picks.append(found)
        rows, picks = np.concatenate(rows), np.concatenate(picks)
        return pa.table({"q": asked.take(pa.array(rows)), "k": keys.take(pa.array(picks)), "similarity": near[rows, picks]})

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each query with their place; the rank limit holds before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "k"))
    return found.withColumn("place", place).filter(F.col("place") <= top)


def _met(chunks: DataFrame, asked: DataFrame, top: int, block: int, query_block: int) -> DataFrame:
    """(q, k, similarity): the best of each query in each block of its document, from (doc, k, v) and (doc, q, v)."""
    blocks = lambda rows, size, name: rows.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = blocks(chunks, block, "cbs").join(blocks(asked, query_block, "qbs"), "doc")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = chunks.join(sizes, "doc").select("doc", own("k", "cbs").alias("cb"), every("qbs").alias("qb"), "k", "v")
    q = asked.join(sizes, "doc").select("doc", own("q", "qbs").alias("qb"), every("cbs").alias("cb"), "q", "v")
    kinds = {f.name: f.dataType.simpleString() for f in (*c.schema, *q.schema)}
    pair = ["doc", "qb", "cb"]
    return c.groupBy(*pair).cogroup(q.groupBy(*pair)).applyInArrow(_best_of_block(top), f"q {kinds['q']}, k {kinds['k']}, similarity double")


def top_many(chunks: DataFrame, queries: DataFrame, key: str, query_key: str, embedding: str = "embedding", top: int = TOP, document: str | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, similarity, place): the most similar vectors of each query, of its own `document` where one is
    named, by comparing everything that may meet.

    Vectors and queries are dealt to blocks; each pair of blocks is one matrix product, from which a query takes its
    best `top`, and these are ranked once more over all blocks. A document of any size is as many blocks as it needs.
    Both tables' own columns may share names.
    """
    c = _rows(chunks, key, embedding, document)
    q = _rows(queries, query_key, embedding, document).withColumnRenamed("k", "q")
    return _ranked(_met(c, q, top, block, query_block), top).select(F.col("q").alias(query_key), F.col("k").alias(key), "similarity", "place")


# ---- the stored index


def write_cells(chunks: DataFrame, path: str, key: str, embedding: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Writes vectors as Parquet under `path`, a folder a cell: cells are the clusters of a bounded sample of `sample`
    vectors (the smallest hashes of the key), about as many as the square root of all; every vector is then put in
    its nearest cell, and a cell keeps its greatest angle, which bounds what can lie in it."""
    rows = _rows(chunks, key, embedding, None).select("k", "v")
    total = rows.count()
    cells = cells or max(1, min(MOST_CELLS, round(total**0.5)))
    some = rows.orderBy(F.xxhash64("k"), "k").limit(sample).mapInArrow(_units, "v array<double>").select(array_to_vector("v").alias("features"))
    spark = chunks.sparkSession
    centres = KMeans(k=cells, seed=seed, maxIter=10, initMode="random", distanceMeasure="cosine").fit(some).clusterCenters() if total else []
    held = [(i, [float(x) for x in c / np.sqrt((c * c).sum())]) for i, c in enumerate(centres)]  # at most MOST_CELLS rows
    matrix = np.array([c for _, c in held]) if held else np.zeros((0, 1))
    near = rows.mapInArrow(_nearest(matrix), f"k {dict(rows.dtypes)['k']}, v array<double>, cell int, angle double")
    files = max(1, -(-total // (max(1, cells) * 65_536)))
    near = near.repartition("cell", F.pmod(F.xxhash64("k"), F.lit(files)))
    near.write.partitionBy("cell").parquet(f"{path}/vectors")
    angles = spark.read.schema("angle double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("angle"))
    table = spark.createDataFrame(held, "cell int, centre array<double>").join(angles, "cell")
    table.coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(key, dict(rows.dtypes)["k"])], "key string, kind string").coalesce(1).write.parquet(f"{path}/meta")


def _units(batches):
    for b in batches:
        m = _unit(pa.chunked_array([b.column(1)]))
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))], names=["v"])


def _nearest(centres: np.ndarray):
    def run(batches):
        for b in batches:
            near = _unit(pa.chunked_array([b.column(1)])) @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(angle)], names=["k", "v", "cell", "angle"])

    return run


class Cells:
    """A stored index, opened: its vectors and, on the driver, the centres of its cells (MOST_CELLS at most)."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/meta").first()
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.key = meta["key"]
        self.vectors = spark.read.schema(f"k {meta['kind']}, v array<double>, angle double, cell int").parquet(f"{path}/vectors")
        self.numbers = np.array([r["cell"] for r in rows], dtype=np.int32)
        self.centres = np.array([r["centre"] for r in rows], dtype=np.float64)
        self.angles = np.array([r["angle"] for r in rows], dtype=np.float64)

    def __len__(self) -> int:
        return len(self.numbers)

    def _probed(self, queries: DataFrame, probes: int, bounded: bool) -> DataFrame:
        """(doc, q, v) for each cell to look into: the `probes` nearest, or with `bounded` those besides that may hold a
        vector as similar as `least`."""
        numbers, centres, angles = self.numbers, self.centres, self.angles

        def run(batches):
            for b in batches:
                near = _unit(pa.chunked_array([b.column(1)])) @ centres.T
                nearest = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(nearest, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if bounded:
                    gap = np.maximum(0, np.arccos(np.clip(near, -1, 1)) - angles)
                    nearest = ~nearest & (np.cos(np.minimum(gap, np.pi)) >= b.column(2).to_numpy(zero_copy_only=False)[:, None] - 1e-7)
                row, cell = np.nonzero(nearest)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[cell], pa.int32()), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["doc", "q", "v"])

        return queries.mapInArrow(run, f"doc int, q {dict(queries.dtypes)['q']}, v array<double>")

    def _looked_up(self, asked: DataFrame, top: int, block: int, query_block: int) -> DataFrame:
        wanted = [r["doc"] for r in asked.select("doc").distinct().collect()]  # at most the number of cells
        rows = self.vectors.filter(F.col("cell").isin(*wanted)).select(F.col("cell").alias("doc"), "k", "v")
        return _met(rows, asked, top, block, query_block)

    def top(self, queries: DataFrame, query_key: str, embedding: str = "embedding", probes: int = 8, top: int = TOP, exact: bool = False, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(query_key, key, similarity, place) of each query from its `probes` nearest cells; only folders of probed
        cells are read. With `exact`, every other cell that its centre and greatest angle do not rule out is looked
        into too, so the answer is that of `top_many`. What is looked up where, and the first answer, are written to the
        shared folder, so that the plan of a step does not repeat those before it."""
        q = _rows(queries, query_key, embedding, None).select(F.col("k").alias("q"), "v")
        if not len(self):
            none = self.vectors.select(F.lit(None).cast(dict(q.dtypes)["q"]).alias("q"), "k", F.lit(0.0).alias("similarity")).limit(0)
            return _ranked(none, top).select(F.col("q").alias(query_key), F.col("k").alias(self.key), "similarity", "place")
        found = _ranked(self._looked_up(_kept(self._probed(q, probes, False), "probed"), top, block, query_block), top)
        if exact:
            found = _kept(found, "found")
            least = found.groupBy("q").agg(F.min(F.when(F.col("place") == top, F.col("similarity"))).alias("least"))
            rest = q.join(least, "q", "left").select("q", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
            more = self._looked_up(_kept(self._probed(rest, probes, True), "probed"), top, block, query_block)
            found = _ranked(found.drop("place").unionByName(more), top)
        return found.select(F.col("q").alias(query_key), F.col("k").alias(self.key), "similarity", "place")


def recall(found: DataFrame, exact: DataFrame, query_key: str, key: str) -> float:
    """The share of the exact answers that were found; 1 if there are none."""
    hit = exact.select(query_key, key).join(found.select(query_key, key).withColumn("hit", F.lit(1)), [query_key, key], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def tuned_probes(index: Cells, queries: DataFrame, query_key: str, embedding: str = "embedding", target: float = RECALL, most: int = TUNING, top: int = TOP) -> tuple[int, float]:
    """(probes, recall): the least power of two of probed cells that reaches the target over at most `most` of the
    queries (the smallest hashes), against the exact answer; all cells in the end."""
    some = queries.orderBy(F.xxhash64(query_key), query_key).limit(most)
    chunks = index.vectors.select(F.col("k").alias(index.key), F.col("v").alias(embedding))
    exact = top_many(chunks, some, index.key, query_key, embedding, top).cache()
    probes = 1
    try:
        while True:
            got = recall(index.top(some, query_key, embedding, probes, top), exact, query_key, index.key)
            if got >= target or probes >= len(index):
                return min(probes, max(1, len(index))), got
            probes *= 2
    finally:
        exact.unpersist()
