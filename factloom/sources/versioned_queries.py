"""Driver query of versioned tables: a history of merges, deletions and a compaction over the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.session import fresh_dir, table
from factloom.sources.versioned import VersionedTable

QUERIES, ORACLES = {}, {}


def versioned_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    k, held = F.col("o_orderkey"), VersionedTable(spark, fresh_dir(spark, "versioned"))
    held.create(orders.filter(k % 5 != 4), "o_orderkey", buckets=16)
    held.merge(orders.filter((k % 5 == 4) | (k % 3 == 0)).withColumn("o_orderstatus", F.lit("X")))
    held.merge(orders.filter(k % 7 == 0), deleted=F.col("o_custkey") % 2 == 0)
    held.compact()
    held.merge(orders.filter(k % 11 == 0).withColumn("o_custkey", -F.col("o_custkey")))
    return held.snapshot()


QUERIES["versioned_merge"] = versioned_merge
ORACLES["versioned_merge"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 4 OR o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice::DOUBLE AS o_totalprice
FROM orders WHERE o_orderkey % 11 = 0 OR NOT (o_orderkey % 7 = 0 AND o_custkey % 2 = 0)"""
