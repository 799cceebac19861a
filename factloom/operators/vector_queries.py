"""Driver queries of vector search for tables of queries, exact and through stored cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import vectors as V
from factloom.session import fresh_dir, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TOP = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0{})
SELECT query_id, vec_id, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id))::INT AS place FROM s QUALIFY place <= 8"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def _shown(found):
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_TOP.format(""))
def vector_top_many(spark, sf_dir):
    return _shown(V.top_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), "vec_id", "query_id"))


@query(_TOP.format(" AND q.label = e.label"))
def vector_top_by_document(spark, sf_dir):
    return _shown(V.top_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), "vec_id", "query_id", document="label"))


def _index(spark, sf_dir):
    path = fresh_dir(spark, "cells")
    V.write_cells(table(spark, sf_dir, "embeddings"), path, "vec_id")
    return V.Cells(spark, path)


@query(_TOP.format(""))
def vector_cells_exact(spark, sf_dir):
    return _shown(_index(spark, sf_dir).top(_asked(spark, sf_dir), "query_id", probes=2, exact=True))


@query()
def vector_cells_recall(spark, sf_dir):
    """Each query's share of its exact best that the tuned number of probed cells finds."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir)
    probes, _ = V.tuned_probes(index, asked, "query_id")
    exact = V.top_many(table(spark, sf_dir, "embeddings"), asked, "vec_id", "query_id").select("query_id", "vec_id")
    found = index.top(asked, "query_id", probes=probes).select("query_id", "vec_id", F.lit(1).alias("hit"))
    each = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return each.select("query_id", F.lit(probes).alias("probes"), F.lit(len(index)).alias("cells"), "recall")
