"""Constraints of the data model as predicates, backfills, and read-side projections.

Every check takes a DataFrame and returns the rows that break it, with the rule's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import semantic_type

# Closed vocabularies of the data model.
PROOF_TYPES = ("VERIFIED", "VERIFIED_OCR", "COMPUTED", "DERIVED", "USER_CONFIRMED", "ESTIMATED", "CONFLICT", "UNVERIFIABLE", "REJECTED")
FACT_TYPES = ("money", "measure", "date", "place", "entity", "obligation", "definition", "relation", "identifier")
STATUSES = ("queued", "processing", "done", "failed")
API_TYPES = ("financial_total", "receipt", "expenditure", "allocation", "tax_collection", "physical_quantity", "statistic", "percentage", "count", "date", "entity", "definition", "obligation")
LOCATORS = {"quote": ("page_quote",), "ocr": ("image_region",), "computation": ("table_range",), "geometry": ("geo_feature",), "manual": ("page_quote", "image_region", "table_range", "geo_feature")}


def _broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows of `df` under each rule they break, as `rule`; one scan."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(found))


def broken_documents(documents: DataFrame) -> DataFrame:
    return _broken(documents, {"PROGRESS_RANGE": F.col("progress").between(0, 100), "STATUS": F.col("status").isin(*STATUSES)})


def repeated_uploads(documents: DataFrame) -> DataFrame:
    """(owner_id, sha256, n) stored more than once."""
    return documents.groupBy("owner_id", "sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def broken_facts(facts: DataFrame) -> DataFrame:
    return _broken(
        facts,
        {
            "VERIFIED_NEEDS_PROOF": ~F.coalesce("verified", F.lit(False)) | F.col("proof_type").isNotNull(),
            "PROOF_TYPE": F.col("proof_type").isNull() | F.col("proof_type").isin(*PROOF_TYPES),
            "FACT_TYPE": F.col("fact_type").isNull() | F.col("fact_type").isin(*FACT_TYPES),
        },
    )


def broken_modal_facts(facts: DataFrame) -> DataFrame:
    """Facts whose verification method and locator don't go together, or whose verdict and reason contradict."""
    legal = reduce(lambda a, kv: a | ((F.col("method") == kv[0]) & F.col("locator_kind").isin(*kv[1])), LOCATORS.items(), F.lit(False))
    return _broken(
        facts,
        {
            "METHOD_LOCATOR": legal,
            "VERIFIED_WITHOUT_REASON": ~F.col("verified") | F.col("fail_reason").isNull(),
            "UNVERIFIED_NEEDS_REASON": F.col("verified") | F.col("fail_reason").isNotNull(),
        },
    )


def unsourced_analyses(analyses: DataFrame) -> DataFrame:
    """Analyses with text but no source fact."""
    return analyses.filter((F.length(F.coalesce("text", F.lit(""))) > 0) & (F.coalesce(F.size("source_fact_ids"), F.lit(0)) < 1))


def boxes_out_of_page(regions: DataFrame) -> DataFrame:
    """Regions (x, y, width, height as shares of a page) that leave it."""
    ok = (F.least("x", "y", "width", "height") >= 0) & (F.col("x") + F.col("width") <= 1.0001) & (F.col("y") + F.col("height") <= 1.0001)
    return regions.filter(~F.coalesce(ok, F.lit(False)))


def with_fact_type(facts: DataFrame) -> DataFrame:
    """Facts with fact_type derived from type where it is missing, and a default proof where a verified fact has none."""
    return facts.withColumns(
        {
            "fact_type": F.coalesce("fact_type", semantic_type(F.col("type"))),
            "proof_type": F.coalesce("proof_type", F.when(F.col("verified"), "VERIFIED").otherwise("UNVERIFIABLE")),
        }
    )


def scale_normalized(facts: DataFrame) -> DataFrame:
    return facts.withColumn("numeric_value", F.round(F.coalesce("normalized_value", "value"), 4).cast("decimal(18,4)"))


def api_facts(facts: DataFrame) -> DataFrame:
    """Stored facts as the read interface gives them: types outside its list as allocation, a label for all, and the
    period text as STRUCT(basis, fiscal_year)."""
    p = F.coalesce("period", F.lit(""))
    basis = F.when(p.rlike(r"(?i)\bBE\b"), "BE").when(p.rlike(r"(?i)\bRE\b"), "RE").when(p.rlike("(?i)actual"), "actual").otherwise("none")
    return facts.withColumns(
        {
            "type": F.when(F.col("type").isin(*API_TYPES), F.col("type")).otherwise("allocation"),
            "label": F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Fact on page "), F.col("page").cast("string"))),
            "period": F.when(F.length(p) > 0, F.struct(basis.alias("basis"), p.alias("fiscal_year"))),
        }
    )


def backfill_document_type(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents with the type that their analysis found, where they have none."""
    found = analyses.groupBy("document_id").agg(F.min("document_type").alias("_found"))
    return documents.join(found, "document_id", "left").withColumn("document_type", F.coalesce("document_type", "_found")).drop("_found")


def backfill_image_sizes(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Sources with width and height read off their document's image-dimension fact ('W x H')."""
    size = r"([0-9]+)\s*x\s*([0-9]+)"
    found = facts.filter((F.col("type") == "image_dimension") & F.col("quote").rlike(size)).groupBy("document_id").agg(F.min("quote").alias("q"))
    number = lambda i: F.regexp_extract("q", size, i).try_cast("int")
    return sources.join(found, "document_id", "left").withColumns({"width": F.coalesce("width", number(1)), "height": F.coalesce("height", number(2))}).drop("q")


def backfill_source_facts(analyses: DataFrame, facts: DataFrame) -> DataFrame:
    """Analyses with the verified facts of their document as sources, where they have none."""
    own = facts.filter("verified").groupBy("document_id").agg(F.array_sort(F.collect_list("fact_id")).alias("_own"))
    joined = analyses.join(own, "document_id", "left")
    return joined.withColumn("source_fact_ids", F.when(F.coalesce(F.size("source_fact_ids"), F.lit(0)) > 0, F.col("source_fact_ids")).otherwise(F.col("_own"))).drop("_own")
