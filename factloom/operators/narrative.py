"""Sentences about facts, their mechanical grounding, and the eight-step storyboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X

# Comparison words, and the words, types and limits of the storyboard's steps.
GREATER = ("greater than", "more than", "higher than", "exceeded", "larger than", "surpassed")
LESSER = ("less than", "smaller than", "lower than", "below", "trailed")
STEPS = (
    ("what_is_this", 2, "speech|budget|order|gazette|notification|docket|act", None, ("entity", "date")),
    ("big_numbers", 3, "total|overall", "total|overall|gross|aggregate|budget estimate|receipt", ()),
    ("where_money_goes", 4, None, "allocation|expenditure|outlay|department|services|works", ("allocation",)),
    ("what_changed", 2, r"increase|decrease|growth|against|compared|revised|\bbe\b|\bre\b", None, ()),
    ("when", 2, r"20\d{2}|fy|quarter|schedule|effective|deadline", None, ()),
    ("where", 2, "ward|zone|district|delhi|mumbai|state|area|circle|sector", "ward|zone|region", ()),
    ("who", 2, "department|council|committee|board|corporation|officer|commissioner|minister", "department|agency|who", ()),
    ("things_to_know", 2, "subject to|condition|clause|provision|note|risk|audit", None, ("obligation", "definition")),
)
PERIOD_STEPS = ("what_changed", "when")
BIG_VALUE = 1_000_000
FALLBACK_ONE = "what_is_this"


def storyboard(facts: DataFrame) -> DataFrame:
    """document_id, step, key, pos and fact_id: up to the step's limit of verified facts that fit it, in input order;
    a step that none fits takes the first verified facts. 'be' and 're' match as words only."""
    known = facts.filter("verified")
    rows = []
    for i, (key, most, quote, label, kinds) in enumerate(STEPS):
        fits = F.lit(False)
        if quote:
            fits |= F.coalesce(F.col("quote").rlike(f"(?i){quote}"), F.lit(False))
        if label:
            fits |= F.coalesce(F.col("label").rlike(f"(?i){label}"), F.lit(False))
        if kinds:
            fits |= F.coalesce(F.col("type").isin(*kinds), F.lit(False))
        if key == "big_numbers":
            fits |= F.coalesce(F.col("value") > BIG_VALUE, F.lit(False))
        if key in PERIOD_STEPS:
            fits |= F.length(F.coalesce("fiscal_year", F.lit(""))) > 0
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(key).alias("key"), F.lit(most).alias("most"), fits.alias("fits")))
    steps = known.select("document_id", "fact_id", "row_idx", F.explode(F.array(*rows)).alias("s")).select("document_id", "fact_id", "row_idx", "s.*")
    w = Window.partitionBy("document_id", "step")
    steps = steps.withColumn("some", F.max("fits").over(w)).filter("fits or not some")
    steps = steps.withColumn("pos", F.row_number().over(w.orderBy("row_idx")))
    most = F.when(~F.col("some") & (F.col("key") == FALLBACK_ONE), 1).otherwise(F.col("most"))
    return steps.filter(F.col("pos") <= most).select("document_id", "step", "key", "pos", "fact_id")


def _says(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def comparison_holds(text: Column, facts: Column) -> Column:
    """Whether a claim that ranks two of its facts (named by the first words of their labels) ranks them by value."""
    low = F.lower(text)
    named = F.filter(
        F.transform(facts, lambda f: F.struct(F.instr(low, F.substring_index(F.lower(f["label"]), " ", 1)).alias("at"), F.substring_index(F.lower(f["label"]), " ", 1).alias("word"), f["value"].alias("value"))),
        lambda s: (F.length(s["word"]) > 0) & (s["at"] > 0),
    )
    two = F.array_sort(F.slice(named, 1, 2))
    a, b = F.try_element_at(two, F.lit(1))["value"], F.try_element_at(two, F.lit(2))["value"]
    wrong = (_says(low, GREATER) & (a <= b)) | (_says(low, LESSER) & (a >= b))
    return ~F.coalesce((F.size(facts) >= 2) & (F.size(named) >= 2) & wrong, F.lit(False))


def ungrounded_numbers(text: Column, values: Column) -> Column:
    """The claim's numbers that are no fact value, sum of some, or share of their total, and neither small nor a year."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def grounded(n: Column) -> Column:
        whole = n == F.floor(n)
        share = (total > 0) & (N.matches_subset_sum(n / 100 * total, values, 0.01) | F.exists(values, lambda v: N.close(n, F.try_divide(v, total) * 100, 0.05)))
        return (
            N.matches_subset_sum(n, values, F.when(whole, 0.0).otherwise(0.001))
            | F.coalesce(share, F.lit(False))
            | (whole & ((n <= 10) | n.between(1990, 2050)))
        )

    return F.filter(N.extract_numbers(text), lambda n: ~grounded(n))


def ground_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, proof_type, confidence, verified and reason of claims (claim_id, text, fact_ids).

    A claim needs a fact that exists; each of its numbers must follow from its facts, and a comparison must hold.
    Dangling fact ids are dropped; claims meet facts by an equi-join on the id.
    """
    cited = claims.select("claim_id", F.posexplode("fact_ids").alias("pos", "fact_id"))
    found = cited.join(facts.select("fact_id", "label", "quote", "unit", "value", "verified"), "fact_id")
    own = found.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "quote", "unit", "value", "verified"))).alias("facts"))
    rows = claims.join(own, "claim_id", "left")
    values = F.filter(F.transform("facts", lambda f: f["value"].cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
    rows = rows.withColumn("loose", F.when(F.col("facts").isNotNull(), ungrounded_numbers(F.col("text"), values)))
    holds = comparison_holds(F.col("text"), F.col("facts"))
    reference = F.array_join(F.transform("facts", lambda f: F.concat_ws(" ", f["label"], f["quote"], f["unit"])), " ")
    reason = F.when(F.col("facts").isNull(), "no fact").when(F.size("loose") > 0, "number").when(~holds, "comparison")
    proof = F.when(reason.isNotNull(), "REJECTED").when(F.forall("facts", lambda f: F.coalesce(f["verified"], F.lit(False))), "VERIFIED").otherwise("ESTIMATED")
    confidence = F.when(reason == "no fact", 0.0).when(reason == "number", 0.2).when(reason == "comparison", 0.1).otherwise(F.greatest(F.lit(0.7), X.token_overlap(F.col("text"), reference)))
    return rows.select("claim_id", proof.alias("proof_type"), confidence.alias("confidence"), reason.isNull().alias("verified"), reason.alias("reason"))


def insights(series: DataFrame, level: str = "standard") -> DataFrame:
    """claim_id, document_id, text and fact_ids: the total, the largest part with its share, and the share of the
    three largest of a chart's series (document_id, pos, fact_id, label, value), worded for a reading level."""
    every = series.groupBy("document_id").agg(
        F.sum("value").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("neg"), "pos", "label", "value", "fact_id"))).alias("s"),
    )
    number = lambda c: N.grouped(c)
    ids = F.transform("s", lambda p: p["fact_id"])
    first, three = F.element_at("s", 1), F.slice("s", 1, 3)
    sum3 = F.aggregate(three, F.lit(0.0), lambda a, p: a + p["value"])
    names = F.array_join(F.transform(three, lambda p: p["label"]), ", ")
    share = lambda c: F.format_string("%.1f", F.try_divide(c * 100, F.col("total")))
    say = {
        "simple": (("Added up, the ", " parts come to "), ("The biggest part is ", ", at "), None),
        "standard": (("Over ", " entries the sum is "), ("The leading entry is ", ", with "), "The first three entries, "),
        "expert": (("The aggregate of ", " observations amounts to "), ("The principal component is ", ", contributing "), "Concentration in the first three, "),
    }[level]
    total = F.when((F.col("total") > 0) & (F.col("n") > 1), F.concat(F.lit(say[0][0]), F.col("n").cast("string"), F.lit(say[0][1]), number(F.col("total")), F.lit(".")))
    top = F.when(F.col("total") > 0, F.concat(F.lit(say[1][0]), first["label"], F.lit(say[1][1]), number(first["value"]), F.lit(" ("), share(first["value"]), F.lit("%).")))
    best = F.when((F.col("total") > 0) & (F.col("n") >= 3), F.concat(F.lit(say[2]), names, F.lit(", hold "), number(sum3), F.lit(" ("), share(sum3), F.lit("%)."))) if say[2] else F.lit(None).cast("string")
    rows = every.select("document_id", F.posexplode(F.array(total, top, best)).alias("k", "text"), ids.alias("fact_ids")).filter("text is not null")
    return rows.select(F.sha2(F.concat_ws("|", "document_id", "k", "text"), 256).alias("claim_id"), "document_id", "text", "fact_ids")


def grounded_insights(series: DataFrame, facts: DataFrame, level: str = "standard") -> DataFrame:
    """The insights that their facts bear out."""
    claims = insights(series, level)
    return claims.join(ground_claims(claims, facts).filter("verified").select("claim_id", "proof_type"), "claim_id")
