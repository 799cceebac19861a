"""Driver queries of constraints, filters and projections of the data model."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as A
from factloom.operators import integrity as I
from factloom.operators import layout as L
from factloom.operators import library as B
from factloom.operators import proposals as R
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """WITH d AS (SELECT o_orderkey AS document_id, o_orderkey % 120 AS progress, CASE WHEN o_orderkey % 50 = 0 THEN 'lost' ELSE 'done' END AS status FROM orders)
SELECT document_id, 'PROGRESS_RANGE' AS rule FROM d WHERE NOT progress BETWEEN 0 AND 100 UNION ALL SELECT document_id, 'STATUS' FROM d WHERE status = 'lost'"""
)
def constraint_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("document_id"), (k % 120).alias("progress"), F.when(k % 50 == 0, "lost").otherwise("done").alias("status"))
    return I.broken_documents(docs).select("document_id", "rule")


@query("SELECT c_nationkey AS owner_id, sha256(c_mktsegment) AS sha256, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_uploads(spark, sf_dir):
    return I.repeated_uploads(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner_id"), F.sha2("c_mktsegment", 256).alias("sha256")))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'money' WHEN 1 THEN 'measure' WHEN 2 THEN 'date' WHEN 3 THEN 'identifier' ELSE 'measure' END AS fact_type,
CASE p_partkey % 4 WHEN 0 THEN 'crore' WHEN 1 THEN 'lakh' WHEN 2 THEN 'unitless' ELSE 'acres' END AS unit, CASE p_partkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE 'NONE' END AS currency FROM part"""
)
def semantic_types(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "financial_total").when(k % 5 == 1, "statistic").when(k % 5 == 2, "date_span").when(k % 5 == 3, "identifier").otherwise("unheard")
    unit = F.when(k % 4 == 0, " Crores ").when(k % 4 == 1, "L").when(k % 4 == 2, "").otherwise("Acres")
    money = F.when(k % 3 == 0, "rs.").when(k % 3 == 1, "dollar")
    return table(spark, sf_dir, "part").select("p_partkey", A.semantic_type(kind).alias("fact_type"), A.unit_name(unit).alias("unit"), A.currency_name(money).alias("currency"))


@query("SELECT o_orderkey AS fact_id FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1 AND o_custkey % 5 = 2")
def fact_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(
        k.alias("fact_id"), F.col("o_orderpriority").alias("label"), F.lit("q").alias("quote"), F.lit(None).cast("double").alias("value"), F.when(k % 2 == 1, "allocation").otherwise("statistic").alias("type"),
        (k % 3 == 0).alias("verified"), F.lit(None).cast("string").alias("proof_type"), (F.col("o_custkey") % 5).alias("page"),
    )
    return B.filter_facts(facts, text="HIGH", semantic="money", proof="needs_review", page=2).select("fact_id")


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def library_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("document_id"), F.concat(F.lit("Budget "), k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".csv")).alias("name"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("queued").alias("status"), k.alias("size_bytes"), k.alias("created_at"))
    return B.search_library(docs, text="budget", status="ready", extensions=("pdf",)).select("document_id")


@query("SELECT p_partkey, round(p_size * 1.00005, 4)::DECIMAL(18, 4) AS numeric_value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size::DECIMAL(18, 4) FROM part WHERE p_partkey % 2 = 1")
def scale_normalized(spark, sf_dir):
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.round(size * 1.00005, 4)).alias("normalized_value"), size.alias("value"))
    return I.scale_normalized(rows).select("p_partkey", "numeric_value")


@query()
def figures_in_text(spark, sf_dir):
    k = F.col("doc_id")
    text = F.concat(F.lit("The total outlay for 2026-27 is INR "), k.cast("string"), F.lit(",500 crore for all works. "), F.col("text"))
    return R.figures_in_text(table(spark, sf_dir, "documents").select(k.alias("document_id"), F.lit(1).alias("page"), text.alias("text")))


@query()
def quote_samples(spark, sf_dir):
    return L.sample_quotes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text"))
