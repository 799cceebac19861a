"""Driver queries of fact operators. Orders stand in for facts, customers for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as A
from factloom.operators import narrative as T
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("document_id"), k.alias("fact_id"), k.alias("row_idx"), F.concat(F.lit("Works item "), k.cast("string")).alias("label"),
        F.when(k % 5 == 0, "financial_total").when(k % 5 == 1, "definition").when(k % 5 == 2, "").otherwise("allocation").alias("type"),
        F.floor(F.col("o_totalprice").cast("double")).cast("double").alias("value"), F.when(k % 3 == 0, "Crores").when(k % 3 == 1, "cr").otherwise("lakh").alias("unit"),
        F.when(k % 2 == 0, "Rs.").otherwise("INR").alias("currency"), F.when(k % 4 == 0, "BE").when(k % 4 == 1, "none").alias("basis"),
        F.when(k % 7 != 0, F.concat(F.lit("20"), F.lpad((10 + k % 5).cast("string"), 2, "0"))).alias("fiscal_year"), F.lit(1).alias("page"),
        F.concat(F.lit("order "), k.cast("string"), F.lit(": priority "), F.col("o_orderpriority")).alias("quote"), (k % 6 != 0).alias("verified"),
        F.when(k % 13 == 0, "ESTIMATED").alias("proof_type"),
    )


_F = """WITH f AS (SELECT o_custkey AS document_id, o_orderkey AS fact_id, o_orderkey AS row_idx, 'Works item ' || o_orderkey AS label,
  CASE o_orderkey % 5 WHEN 0 THEN 'financial_total' WHEN 1 THEN 'definition' WHEN 2 THEN '' ELSE 'allocation' END AS type, floor(o_totalprice::DOUBLE) AS value,
  CASE o_orderkey % 3 WHEN 0 THEN 'crore' WHEN 1 THEN 'crore' ELSE 'lakh' END AS unit, 'INR' AS currency,
  CASE o_orderkey % 4 WHEN 0 THEN 'BE' WHEN 1 THEN 'none' END AS basis, CASE WHEN o_orderkey % 7 <> 0 THEN '20' || lpad((10 + o_orderkey % 5)::VARCHAR, 2, '0') END AS fiscal_year,
  'order ' || o_orderkey || ': priority ' || o_orderpriority AS quote, o_orderkey % 6 <> 0 AS verified, CASE WHEN o_orderkey % 13 = 0 THEN 'ESTIMATED' END AS proof_type FROM orders),
"""
_DOM = """{n}c AS (SELECT document_id, unit, count(*) AS n, min(row_idx) AS first FROM {src} GROUP BY 1, 2),
{n}b AS (SELECT document_id, arg_max(unit, n * 1000000000 - first) AS unit FROM {n}c GROUP BY 1),
{n} AS (SELECT s.* FROM {src} s JOIN {n}b USING (document_id, unit))"""
_Q = "q AS (SELECT * FROM f WHERE coalesce(proof_type, CASE WHEN verified THEN 'VERIFIED' ELSE 'UNVERIFIABLE' END) IN ('VERIFIED', 'VERIFIED_OCR', 'COMPUTED', 'DERIVED') AND value > 0),\n"


@query(_F + _Q + _DOM.format(n="d", src="q") + " SELECT document_id, unit AS unit_name, count(*)::BIGINT AS n FROM d GROUP BY 1, 2")
def dominant_bucket(spark, sf_dir):
    d = A.dominant(A.quantified(A.shown(_facts(spark, sf_dir))))
    return d.groupBy("document_id", "unit_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    _F
    + """k0 AS (SELECT *, max((type <> 'financial_total')::INT) OVER (PARTITION BY document_id) AS lines FROM f WHERE verified AND value IS NOT NULL), k AS (SELECT * FROM k0 WHERE lines = 0 OR type <> 'financial_total'),
"""
    + _DOM.format(n="d", src="k")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY value DESC, row_idx) AS rank FROM d) SELECT document_id, rank::INT AS rank, fact_id, CASE WHEN length(quote) > 28 THEN substr(quote, 1, 26) || '...' ELSE quote END AS name, value FROM r WHERE rank <= 8"
)
def top_allocations(spark, sf_dir):
    return A.top_allocations(_facts(spark, sf_dir))


@query(
    _F
    + "k AS (SELECT * FROM f WHERE verified AND fiscal_year IS NOT NULL),\n"
    + _DOM.format(n="d", src="k")
    + " SELECT document_id, trim(CASE WHEN coalesce(basis, 'none') <> 'none' THEN basis || ' ' ELSE '' END || fiscal_year) AS period, sum(value) AS total FROM d GROUP BY 1, 2"
)
def trend_by_period(spark, sf_dir):
    return A.trend(_facts(spark, sf_dir))


@query(
    _F
    + """c AS (SELECT document_id, CASE WHEN type = '' THEN 'general' ELSE type END AS category, count(*)::BIGINT AS n, count(*) FILTER (verified)::BIGINT AS verified FROM f GROUP BY 1, 2)
SELECT *, round(n * 1000 / sum(n) OVER (PARTITION BY document_id)::DOUBLE) / 10 AS percent FROM c"""
)
def category_counts(spark, sf_dir):
    return A.category_counts(_facts(spark, sf_dir))


@query(_F + _Q + _DOM.format(n="d", src="q") + " SELECT document_id, fact_id, round(value * 1000 / sum(value) OVER (PARTITION BY document_id)) / 10 AS share FROM d")
def share_of_total(spark, sf_dir):
    return A.shares(_facts(spark, sf_dir))


@query(
    _F
    + """k AS (SELECT *, lower(type) AS kind, coalesce(fiscal_year, 'all') AS period FROM f)
SELECT a.document_id, a.kind, a.period, a.fact_id AS a_id, b.fact_id AS b_id, abs(a.value - b.value) AS difference FROM k a JOIN k b USING (document_id, kind, period)
WHERE a.row_idx < b.row_idx AND abs(a.value - b.value) > 0.01"""
)
def conflict_pairs(spark, sf_dir):
    return A.conflicts(_facts(spark, sf_dir))


@query(
    _F
    + """k AS (SELECT document_id, lower(type) AS kind, coalesce(fiscal_year, 'all') AS period, fact_id, row_idx, value FROM f),
v AS (SELECT document_id, kind, period, value, arg_min(fact_id, row_idx) AS first_id, count(*)::BIGINT AS facts FROM k GROUP BY ALL)
SELECT a.*, sum(b.facts)::BIGINT AS links FROM v a JOIN v b USING (document_id, kind, period) WHERE abs(a.value - b.value) > 0.01 GROUP BY ALL"""
)
def conflict_classes(spark, sf_dir):
    return A.conflict_classes(_facts(spark, sf_dir))


@query(_F + "k AS (SELECT * FROM f WHERE type = 'definition') SELECT document_id, fact_id, trim(CASE WHEN strpos(quote, ':') - 1 BETWEEN 1 AND 39 THEN substr(quote, 1, strpos(quote, ':') - 1) ELSE substr(quote, 1, 30) END) AS term, quote AS definition FROM k")
def glossary_terms(spark, sf_dir):
    return A.glossary(_facts(spark, sf_dir))


@query(
    _F
    + """r AS (SELECT fact_id, CASE WHEN fact_id % 8 = 0 THEN 'approve' WHEN fact_id % 8 = 1 THEN 'reject' END AS d, verified, proof_type FROM f)
SELECT fact_id, CASE d WHEN 'approve' THEN true WHEN 'reject' THEN false ELSE verified END AS verified,
CASE d WHEN 'approve' THEN 'USER_CONFIRMED' WHEN 'reject' THEN 'REJECTED' ELSE coalesce(proof_type, CASE WHEN verified THEN 'VERIFIED' ELSE 'UNVERIFIABLE' END) END AS proof_type,
CASE WHEN d = 'reject' THEN 'REVIEWER_REJECTED' END AS fail_reason FROM r"""
)
def review_decisions(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    decisions = facts.filter("fact_id % 8 < 2").select("fact_id", F.when(F.col("fact_id") % 8 == 0, "approve").otherwise("reject").alias("decision"))
    return A.review(facts, decisions).select("fact_id", "verified", "proof_type", "fail_reason")


@query(_F + "i AS (SELECT p_partkey AS item_id, p_partkey * 3 AS fact_id FROM part) SELECT item_id, fact_id, label, quote FROM i LEFT JOIN f USING (fact_id)")
def review_queue(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") * 3).alias("fact_id"))
    return A.review_queue(items, _facts(spark, sf_dir)).select("item_id", "fact_id", "label", "quote")


@query(
    _F
    + _Q
    + _DOM.format(n="d0", src="q")
    + """, d AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS size, row_number() OVER (PARTITION BY document_id ORDER BY value DESC, row_idx) AS big, row_number() OVER (PARTITION BY document_id ORDER BY row_idx) AS seen FROM d0),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY value DESC, row_idx) AS big FROM q),
y0 AS (SELECT *, row_number() OVER (PARTITION BY document_id, fiscal_year ORDER BY row_idx) AS nth FROM d WHERE fiscal_year IS NOT NULL),
y AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS periods, row_number() OVER (PARTITION BY document_id ORDER BY fiscal_year) AS place FROM y0 WHERE nth = 1),
u AS (SELECT document_id, 'key_figures_strip' AS kind, 1 AS rank, big AS pos, fact_id, label, value FROM k WHERE big <= 4
UNION ALL SELECT document_id, CASE WHEN size <= 6 THEN 'donut_pie' ELSE 'treemap' END, 2, big, fact_id, label, value FROM d WHERE size BETWEEN 2 AND 6 OR (size > 6 AND big <= 12)
UNION ALL SELECT document_id, 'horizontal_ranked_bar', 3, big, fact_id, label, value FROM d WHERE size >= 3 AND big <= 8
UNION ALL SELECT document_id, CASE WHEN periods >= 4 THEN 'line_area' ELSE 'slope_chart' END, 4, place, fact_id, fiscal_year, value FROM y WHERE periods >= 2
UNION ALL SELECT document_id, 'grouped_stacked_bar', 5, seen, fact_id, label, value FROM d WHERE size >= 2 AND seen <= 6
UNION ALL SELECT document_id, 'bullet_gauge', 6, seen, fact_id, label, value FROM d WHERE seen = 1)
SELECT document_id, kind, rank::INT AS rank, pos::INT AS pos, fact_id, label, value FROM u"""
)
def chart_candidates(spark, sf_dir):
    return A.chart_candidates(_facts(spark, sf_dir))


@query("SELECT o_custkey AS document_id, count(*) FILTER (o_orderkey % 50 = 0)::INT AS bare FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 50 = 0) > 0")
def provenance_violations(spark, sf_dir):
    point = F.struct(F.col("fact_id"), F.when(F.col("fact_id") % 50 != 0, F.array("fact_id")).otherwise(F.array().cast("array<bigint>")).alias("fact_ids"))
    specs = _facts(spark, sf_dir).groupBy("document_id").agg(F.collect_list(point).alias("series"))
    return A.unproven_points(specs).select("document_id", F.size(F.filter("series", lambda p: F.size(p["fact_ids"]) == 0)).alias("bare"))


@query(
    _F
    + """s AS (SELECT document_id, fact_id, row_idx, unnest([
 {'step': 1, 'key': 'what_is_this', 'most': 2, 'fits': regexp_matches(quote, 'speech|budget|order|gazette|notification|docket|act', 'i') OR type IN ('entity', 'date')},
 {'step': 2, 'key': 'big_numbers', 'most': 3, 'fits': regexp_matches(quote, 'total|overall', 'i') OR regexp_matches(label, 'total|overall|gross|aggregate|budget estimate|receipt', 'i') OR value > 1000000},
 {'step': 3, 'key': 'where_money_goes', 'most': 4, 'fits': regexp_matches(label, 'allocation|expenditure|outlay|department|services|works', 'i') OR type = 'allocation'},
 {'step': 4, 'key': 'what_changed', 'most': 2, 'fits': regexp_matches(quote, 'increase|decrease|growth|against|compared|revised|\\bbe\\b|\\bre\\b', 'i') OR fiscal_year IS NOT NULL},
 {'step': 5, 'key': 'when', 'most': 2, 'fits': regexp_matches(quote, '20\\d{2}|fy|quarter|schedule|effective|deadline', 'i') OR fiscal_year IS NOT NULL},
 {'step': 6, 'key': 'where', 'most': 2, 'fits': regexp_matches(quote, 'ward|zone|district|delhi|mumbai|state|area|circle|sector', 'i') OR regexp_matches(label, 'ward|zone|region', 'i')},
 {'step': 7, 'key': 'who', 'most': 2, 'fits': regexp_matches(quote, 'department|council|committee|board|corporation|officer|commissioner|minister', 'i') OR regexp_matches(label, 'department|agency|who', 'i')},
 {'step': 8, 'key': 'things_to_know', 'most': 2, 'fits': regexp_matches(quote, 'subject to|condition|clause|provision|note|risk|audit', 'i') OR type IN ('obligation', 'definition')}]) AS x FROM f WHERE verified),
g AS (SELECT *, bool_or(x.fits) OVER (PARTITION BY document_id, x.step) AS any_fit FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, x.step ORDER BY row_idx) AS pos FROM g WHERE x.fits OR NOT any_fit)
SELECT document_id, x.step::INT AS step, x.key AS key, pos::INT AS pos, fact_id FROM n WHERE pos <= CASE WHEN NOT any_fit AND x.key = 'what_is_this' THEN 1 ELSE x.most END"""
)
def storyboard_steps(spark, sf_dir):
    return T.storyboard(_facts(spark, sf_dir))


@query()
def insight_sentences(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    series = A.chart_candidates(facts).filter("kind = 'horizontal_ranked_bar'")
    return T.grounded_insights(series, facts).select("claim_id", "document_id", "text", "proof_type")


@query(
    """SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 4 = 3 THEN 'REJECTED' ELSE CASE WHEN o_orderkey % 6 <> 0 THEN 'VERIFIED' ELSE 'ESTIMATED' END END AS proof_type,
CASE o_orderkey % 4 WHEN 1 THEN 'number' WHEN 3 THEN 'no fact' END AS reason FROM orders"""
)
def ground_claims(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    k = F.col("fact_id")
    stated = F.when(k % 4 == 1, F.col("value") * 3 + 777777).otherwise(F.col("value")).cast("long").cast("string")
    claims = facts.select(k.alias("claim_id"), F.concat(F.lit("The figure is "), stated, F.lit(".")).alias("text"), F.array(F.when(k % 4 == 3, -k).otherwise(k)).alias("fact_ids"))
    return T.ground_claims(claims, facts).select("claim_id", "proof_type", "reason")
