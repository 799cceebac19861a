"""Driver query of the job queue: three workers over the orders as jobs, one of which loses its leases."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.session import fresh_dir, table
from factloom.streaming.queue import JobQueue

QUERIES, ORACLES = {}, {}


def queue_claims(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    queue = JobQueue(spark, fresh_dir(spark, "queue"))
    queue.create(orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") * 7919 % 10007).alias("created_at"), (F.col("o_orderkey") % 4).alias("attempts")))
    share = orders.count() // 5
    first = queue.claim("a", now=0, lease=10, count=share)
    queue.claim("b", now=5, lease=10, count=share)
    queue.settle(first, now=9)
    queue.claim("c", now=20, lease=10, count=share)
    queue.give_up(now=20)
    return queue.jobs().select("job_id", "attempts", "status", "worker", F.coalesce("lease_until", F.lit(-1)).alias("lease_until"))


QUERIES["queue_claims"] = queue_claims
ORACLES["queue_claims"] = """
WITH j AS (SELECT o_orderkey AS job_id, o_orderkey * 7919 % 10007 AS created_at, o_orderkey % 4 AS attempts, (SELECT count(*) // 5 FROM orders) AS share FROM orders),
r AS (SELECT *, CASE WHEN attempts < 3 THEN row_number() OVER (PARTITION BY attempts < 3 ORDER BY created_at, job_id) END AS place FROM j),
h AS (SELECT *, CASE WHEN place <= share THEN 'a' WHEN place <= 2 * share THEN 'b' END AS holder FROM r),
f AS (SELECT *, place > 2 * share OR (holder = 'b' AND attempts + 1 < 3) AS free FROM h),
c AS (SELECT *, free AND row_number() OVER (PARTITION BY free ORDER BY created_at, job_id) <= share AS again FROM f)
SELECT job_id, (attempts + (holder IS NOT NULL)::INT + coalesce(again, false)::INT)::INT AS attempts,
  CASE WHEN again THEN 'held' WHEN holder = 'a' THEN 'done' WHEN holder = 'b' AND attempts + 1 >= 3 THEN 'failed' WHEN holder = 'b' THEN 'held' ELSE 'queued' END AS status,
  CASE WHEN again THEN 'c' ELSE holder END AS worker, (CASE WHEN again THEN 30 WHEN holder = 'a' THEN 10 WHEN holder = 'b' THEN 15 ELSE -1 END)::BIGINT AS lease_until
FROM c"""
