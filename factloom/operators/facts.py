"""Facts: typing, dominant units, rankings, trends, conflicts, glossary, review, and chart candidates.

A facts table has document_id, fact_id, row_idx (input order within a document), label, type, value, unit,
currency, basis, fiscal_year, page, quote, verified and proof_type. Every operator works on all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.numbers import percent

# Type groups, unit and currency spellings, proof types fit for an overview.
SEMANTIC_TYPES = {
    "money": ("financial_allocation", "financial_total", "allocation", "money", "expenditure", "receipt"),
    "measure": ("statistic", "percentage", "count", "measure", "physical_quantity"),
    "date": ("date", "date_span"),
    "place": ("place",),
    "entity": ("entity",),
    "obligation": ("obligation",),
    "definition": ("definition",),
    "relation": ("relation",),
    "identifier": ("identifier",),
}
UNITS = {
    "crore": ("crore", "crores", "cr"),
    "lakh": ("lakh", "lakhs", "l"),
    "percent": ("percent", "%", "percentage"),
    "km": ("km", "kilometer", "kilometres"),
    "count": ("count", "number", "units"),
}
CURRENCIES = {"INR": ("INR", "₹", "RS", "RS.", "RUPEES"), "USD": ("USD", "$", "DOLLAR")}
SHOWN_PROOFS = ("VERIFIED", "VERIFIED_OCR", "COMPUTED", "DERIVED")
ESTIMATE_PROOFS = ("USER_CONFIRMED", "ESTIMATED")
CONFLICT_GAP = 0.01


def _spelled(c: Column, table: dict, empty: str) -> Column:
    out = F
    for name, spellings in table.items():
        out = out.when(c.isin(*spellings), name)
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, empty).otherwise(out.otherwise(c))


def unit_name(c: Column) -> Column:
    return _spelled(F.lower(F.trim(c)), UNITS, "unitless")


def currency_name(c: Column) -> Column:
    return _spelled(F.upper(F.trim(c)), CURRENCIES, "NONE")


def semantic_type(c: Column) -> Column:
    out = F
    for name, kinds in SEMANTIC_TYPES.items():
        out = out.when(c.isin(*kinds), name)
    return out.otherwise("measure")


def effective_proof() -> Column:
    return F.coalesce("proof_type", F.when(F.col("verified"), "VERIFIED").otherwise("UNVERIFIABLE"))


def shown(facts: DataFrame, include_estimates: bool = False) -> DataFrame:
    """Facts whose proof is fit for an overview."""
    proofs = SHOWN_PROOFS + (ESTIMATE_PROOFS if include_estimates else ())
    return facts.filter(effective_proof().isin(*proofs))


def quantified(facts: DataFrame) -> DataFrame:
    return facts.filter("value is not null and not isnan(value) and value > 0")


def dominant(facts: DataFrame) -> DataFrame:
    """The facts of each document's most frequent (unit, currency), the first seen among equals, with unit_name and currency_name."""
    named = facts.withColumns({"unit_name": unit_name(F.col("unit")), "currency_name": currency_name(F.col("currency"))})
    counts = named.groupBy("document_id", "unit_name", "currency_name").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    best = counts.groupBy("document_id").agg(F.max_by(F.struct("unit_name", "currency_name"), F.struct(F.col("n"), -F.col("first"))).alias("b"))
    best = best.select("document_id", "b.unit_name", "b.currency_name")
    return named.join(best, ["document_id", "unit_name", "currency_name"])


def _per_document(*order: Column):
    return Window.partitionBy("document_id").orderBy(*order)


def top_allocations(facts: DataFrame, most: int = 8) -> DataFrame:
    """document_id, rank, fact_id, name and value of the largest verified figures in the dominant unit; totals
    are left out unless nothing else remains."""
    known = facts.filter("verified and value is not null and not isnan(value)")
    lines = F.max(F.when(F.col("type") != "financial_total", 1).otherwise(0)).over(Window.partitionBy("document_id"))
    lines = known.withColumn("lines", lines).filter("lines = 0 or type <> 'financial_total'").drop("lines")
    ranked = dominant(lines).withColumn("rank", F.row_number().over(_per_document(F.desc("value"), F.col("row_idx"))))
    return ranked.filter(F.col("rank") <= most).select("document_id", "rank", "fact_id", X.short_label(F.col("quote")).alias("name"), "value")


def period_label() -> Column:
    basis = F.when(F.coalesce("basis", F.lit("none")) != "none", F.col("basis"))
    label = F.concat_ws(" ", basis, F.when(F.length("fiscal_year") > 0, F.col("fiscal_year")))
    return F.when(F.length(label) > 0, label).otherwise("Unspecified")


def trend(facts: DataFrame) -> DataFrame:
    """document_id, period and total of verified figures with a fiscal year, in the dominant unit."""
    known = facts.filter("verified and value is not null and length(coalesce(fiscal_year, '')) > 0")
    return dominant(known).groupBy("document_id", period_label().alias("period")).agg(F.sum("value").alias("total"))


def category_counts(facts: DataFrame) -> DataFrame:
    """document_id, category, n, verified and percent of each fact type."""
    kind = F.when(F.length(F.coalesce("type", F.lit(""))) == 0, "general").otherwise(F.col("type"))
    counts = facts.groupBy("document_id", kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"))
    return counts.withColumn("percent", percent(F.col("n"), F.sum("n").over(Window.partitionBy("document_id"))))


def shares(facts: DataFrame) -> DataFrame:
    """document_id, fact_id and share (percent, one decimal) of each dominant figure in their total."""
    rows = dominant(quantified(shown(facts)))
    return rows.select("document_id", "fact_id", percent(F.col("value"), F.sum("value").over(Window.partitionBy("document_id"))).alias("share"))


def conflicts(facts: DataFrame, gap: float = CONFLICT_GAP) -> DataFrame:
    """Pairs of facts of one document, type and period whose values differ: document_id, kind, period, a_id, b_id and difference.

    All pairs, so the square of a key's facts; `conflict_classes` tells the same without expanding them.
    """
    rows = facts.filter("value is not null and type is not null").select("document_id", F.lower("type").alias("kind"), F.coalesce("fiscal_year", F.lit("all")).alias("period"), "fact_id", "row_idx", "value")
    key = ["document_id", "kind", "period"]
    spread = rows.groupBy(*key).agg((F.max("value") - F.min("value")).alias("spread")).filter(F.col("spread") > gap).select(*key)
    open_ = rows.join(spread, key)
    side = lambda s: open_.select(*key, *[F.col(c).alias(f"{s}_{c}") for c in ("fact_id", "row_idx", "value")])
    pairs = side("a").join(side("b"), key).filter((F.col("a_row_idx") < F.col("b_row_idx")) & (F.abs(F.col("a_value") - F.col("b_value")) > gap))
    return pairs.select(*key, F.col("a_fact_id").alias("a_id"), F.col("b_fact_id").alias("b_id"), F.abs(F.col("a_value") - F.col("b_value")).alias("difference"))


def conflict_classes(facts: DataFrame, gap: float = CONFLICT_GAP) -> DataFrame:
    """The sides of conflicts, one row a value: document_id, kind, period, value, first_id (the fact that stands first),
    facts (those that state the value) and links (facts of the key whose values differ from it by more than the gap).

    Equal facts are counted before the shuffle and links are taken from sums over the sorted values, so a key of n
    facts and k values costs k rows, not the square of n. Values that nothing conflicts with are left out;
    values a gap apart to the last bit may round to either side.
    """
    key = ["document_id", "kind", "period"]
    rows = facts.filter("value is not null and type is not null").select("document_id", F.lower("type").alias("kind"), F.coalesce("fiscal_year", F.lit("all")).alias("period"), "fact_id", "row_idx", F.col("value").cast("double").alias("value"))
    values = rows.groupBy(*key, "value").agg(F.min_by("fact_id", "row_idx").alias("first_id"), F.count(F.lit(1)).alias("facts"))
    within = f"{float(gap)!r}D"
    near = F.expr(f"sum(facts) over (partition by document_id, kind, period order by value range between {within} preceding and {within} following)")
    return values.withColumn("links", F.sum("facts").over(Window.partitionBy(*key)) - near).filter("links > 0")


def glossary(facts: DataFrame) -> DataFrame:
    """document_id, fact_id, term and definition of facts that define something (by type or semantic type)."""
    return facts.filter(semantic_type(F.col("type")) == "definition").select("document_id", "fact_id", X.glossary_term(F.col("quote")).alias("term"), F.col("quote").alias("definition"))


def review(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts after review decisions (fact_id, decision): approval confirms and clears the reason, rejection rejects."""
    d = F.col("decision")
    return facts.join(decisions.select("fact_id", "decision"), "fact_id", "left").select(
        *[c for c in facts.columns if c not in ("verified", "proof_type", "fail_reason")],
        F.when(d == "approve", True).when(d == "reject", False).otherwise(F.col("verified")).alias("verified"),
        F.when(d == "approve", "USER_CONFIRMED").when(d == "reject", "REJECTED").otherwise(effective_proof()).alias("proof_type"),
        F.when(d == "approve", F.lit(None)).when(d == "reject", "REVIEWER_REJECTED").otherwise(F.col("fail_reason") if "fail_reason" in facts.columns else F.lit(None)).cast("string").alias("fail_reason"),
    )


def review_queue(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Review items with the label and quote of their fact, where it still exists."""
    return items.join(facts.select("fact_id", "label", "quote"), "fact_id", "left")


def chart_candidates(facts: DataFrame, include_estimates: bool = False) -> DataFrame:
    """document_id, kind, rank, pos, fact_id, label and value: the series of each chart that a document's facts support.

    key_figures_strip (4 largest), donut_pie (2 to 6 parts) or treemap (12 largest of more), horizontal_ranked_bar
    (8 largest of 3 or more), slope_chart (2 or 3 periods) or line_area (4 or more; the first fact of each),
    grouped_stacked_bar (first 6 of 2 or more) and bullet_gauge (the first).
    """
    q = quantified(shown(facts, include_estimates))
    d = dominant(q).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    by_value = F.row_number().over(_per_document(F.desc("value"), F.col("row_idx")))
    by_input = F.row_number().over(_per_document(F.col("row_idx")))
    d = d.withColumns({"big": by_value, "seen": by_input})

    def series(df: DataFrame, kind: Column, rank: int, pos: str, label: str = "label") -> DataFrame:
        return df.select("document_id", kind.alias("kind"), F.lit(rank).alias("rank"), F.col(pos).cast("int").alias("pos"), "fact_id", F.col(label).alias("label"), "value")

    parts = d.filter("size between 2 and 6 or (size > 6 and big <= 12)")
    years = d.filter("length(coalesce(fiscal_year, '')) > 0").withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "fiscal_year").orderBy("row_idx"))).filter("nth = 1")
    years = years.withColumns({"periods": F.count(F.lit(1)).over(Window.partitionBy("document_id")), "at": F.row_number().over(_per_document(F.col("fiscal_year")))})
    found = [
        series(q.withColumn("big", by_value).filter("big <= 4"), F.lit("key_figures_strip"), 1, "big"),
        series(parts, F.when(F.col("size") <= 6, "donut_pie").otherwise("treemap"), 2, "big"),
        series(d.filter("size >= 3 and big <= 8"), F.lit("horizontal_ranked_bar"), 3, "big"),
        series(years.filter("periods >= 2"), F.when(F.col("periods") >= 4, "line_area").otherwise("slope_chart"), 4, "at", "fiscal_year"),
        series(d.filter("size >= 2 and seen <= 6"), F.lit("grouped_stacked_bar"), 5, "seen"),
        series(d.filter("seen = 1"), F.lit("bullet_gauge"), 6, "seen"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def unproven_points(specs: DataFrame) -> DataFrame:
    """Chart specs (with series: ARRAY<STRUCT<.., fact_ids>>) that hold a point without a cited fact."""
    return specs.filter(F.exists("series", lambda p: F.coalesce(F.size(p["fact_ids"]), F.lit(0)) < 1))
