"""Driver queries of the tabular operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import tabular as tab
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _measures(spark, sf_dir):
    """lineitem's measures with nulls: every ninth discount is null."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_discount").cast("double")).alias("l_discount"))


_LONG = """WITH m AS (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, CASE WHEN l_orderkey % 9 <> 0 THEN l_discount::DOUBLE END AS l_discount FROM lineitem),
l AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM m UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM m UNION ALL SELECT 'l_discount', l_discount FROM m),
q AS (SELECT "column", list_sort(list(v)) AS s, len(list(v)) AS n FROM l WHERE v IS NOT NULL GROUP BY 1),
qq AS (SELECT "column", s[floor(n * 0.25)::BIGINT + 1] AS q1, s[floor(n * 0.75)::BIGINT + 1] AS q3 FROM q)
"""


@query(
    """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders)
SELECT * FROM (VALUES ('id', 'number'), ('price', 'currency'), ('share', 'percentage'), ('day', 'date'), ('status', 'string'), ('nothing', 'string')) v("column", inferred_type)"""
)
def type_inference(spark, sf_dir):
    return tab.infer_types(_as_text(spark, sf_dir))


def _as_text(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("double"), 2)).alias("price"),
        F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(".5%"))).alias("share"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderstatus").alias("status"),
        F.lit("NULL").alias("nothing"),
    )


@query(
    """SELECT o_orderkey::DOUBLE AS id, o_orderkey::VARCHAR AS id_text, round(o_totalprice::DOUBLE, 2) AS price,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_custkey % 100)::VARCHAR || '.5%' END AS share, o_orderstatus AS status, NULL::VARCHAR AS nothing FROM orders"""
)
def cell_coercion(spark, sf_dir):
    return tab.coerce(_as_text(spark, sf_dir), {"id": "number", "price": "currency"}).drop("price_text", "day")


@query(
    _LONG
    + """SELECT "column", count(v)::BIGINT AS count, count(*) FILTER (v IS NULL)::BIGINT AS null_count, count(*) FILTER (v IS NULL) / count(*)::DOUBLE AS null_rate,
       min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, median(v) AS median FROM l GROUP BY 1"""
)
def profile_numeric(spark, sf_dir):
    return tab.profile(_measures(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(_LONG + "SELECT * FROM qq")
def quartiles(spark, sf_dir):
    return tab.quartiles(_measures(spark, sf_dir))


@query(_LONG + """SELECT l."column", v, count(*)::BIGINT AS n FROM l JOIN qq ON l."column" = qq."column" WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""")
def outliers(spark, sf_dir):
    return tab.outliers(_measures(spark, sf_dir))


_PAIR = "SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)::BIGINT AS n, round(coalesce(corr({a}, {b}), 0), 4) AS r FROM m"


@query(_LONG + " UNION ALL ".join(_PAIR.format(a=_COLS[i], b=_COLS[j]) for i, j in ((0, 1), (0, 2), (1, 2))))
def pearson_pairs(spark, sf_dir):
    return tab.pearson_pairs(_measures(spark, sf_dir))


@query(
    """WITH s AS (SELECT min(o_totalprice::DOUBLE) AS lo, max(o_totalprice::DOUBLE) AS hi, (max(o_totalprice::DOUBLE) - min(o_totalprice::DOUBLE)) / 5 AS w FROM orders),
b AS (SELECT least(floor((o_totalprice::DOUBLE - lo) / w), 4)::INT AS bin, count(*)::BIGINT AS n FROM orders, s GROUP BY 1)
SELECT r.bin::INT AS bin, round(lo + r.bin * w, 4) AS lo, round(lo + (r.bin + 1) * w, 4) AS hi, coalesce(n, 0)::BIGINT AS n FROM range(5) r(bin) CROSS JOIN s LEFT JOIN b ON b.bin = r.bin"""
)
def histogram5(spark, sf_dir):
    return tab.histogram(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query(
    """WITH o AS (SELECT list_sort(list(o_totalprice::DOUBLE)) AS s, count(*) AS n, median(o_totalprice::DOUBLE) AS m FROM orders)
SELECT 0 AS seq, 'min' AS label, s[1] AS value FROM o UNION ALL SELECT 1, 'q1', s[floor(n * 0.25)::BIGINT + 1] FROM o UNION ALL SELECT 2, 'median', m FROM o
UNION ALL SELECT 3, 'q3', s[floor(n * 0.75)::BIGINT + 1] FROM o UNION ALL SELECT 4, 'max', s[n] FROM o"""
)
def five_number_summary(spark, sf_dir):
    return tab.five_numbers(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    """SELECT l_returnflag, round(sum(l_quantity::DOUBLE), 4) AS frame_total, round(sum(l_quantity::DOUBLE), 4) AS sql_total, 'COMPUTED' AS proof_type FROM lineitem GROUP BY 1"""
)
def dual_computation(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    df.createOrReplaceTempView("factloom_lineitem")
    one = df.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("double")).alias("a"))
    two = spark.sql("SELECT l_returnflag, sum(cast(l_quantity AS double)) AS b FROM factloom_lineitem GROUP BY l_returnflag")
    both = one.join(two, "l_returnflag")
    return both.select("l_returnflag", F.round("a", 4).alias("frame_total"), F.round("b", 4).alias("sql_total"), N.computed_twice(F.col("a"), F.col("b"))["proof_type"].alias("proof_type"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END AS cell FROM (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=cmd|' WHEN 1 THEN '+2' WHEN 2 THEN '-5' WHEN 3 THEN '@SUM' ELSE '' END || p_name AS c FROM part)"""
)
def csv_safe_export(spark, sf_dir):
    prefix = F.when(F.col("p_partkey") % 5 == 0, "=cmd|").when(F.col("p_partkey") % 5 == 1, "+2").when(F.col("p_partkey") % 5 == 2, "-5").when(F.col("p_partkey") % 5 == 3, "@SUM").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", tab.safe_cell(F.concat(prefix, F.col("p_name"))).alias("cell"))


@query(_LONG + """SELECT "column", 'sum' AS measure, round(sum(v), 4) AS value, false AS verified FROM l GROUP BY 1 UNION ALL SELECT "column", 'max', round(max(v), 4), false FROM l GROUP BY 1""")
def column_totals(spark, sf_dir):
    return tab.column_totals(_measures(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("SELECT n_nationkey, 'n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS line FROM nation")
def row_to_text(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.row_as_text(["n_name", "n_regionkey"]).alias("line"))
