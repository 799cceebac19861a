"""Verification of proposed facts against the text of their page, as one ordered chain of conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.numbers import grouped, plain_text
from factloom.session import fresh_dir

# Fact types by the checks they need, and the words of dates and headings.
MONEY_TYPES = ("financial_total", "receipt", "expenditure", "allocation", "tax_collection")
UNIT_TYPES = (*MONEY_TYPES, "physical_quantity")
MONEY_MARKS = ("rs", "rs.", "₹", "inr")
YEAR_WORDS = r"vision\s*@|year|march|september|october|november|december|january|february|in|by|fy|be|re"
HEADING_WORDS = "section|item|point|clause|heading"
REASONS = (
    "PAGE_TEXT_MISSING",
    "QUOTE_NOT_ON_SINGLE_PAGE",
    "YEAR_OR_DATE_AS_VALUE",
    "HEADING_NUMBER",
    "PAGE_OR_ID_NUMBER",
    "VALUE_NOT_IN_QUOTE",
    "MISSING_REQUIRED_UNIT",
    "UNIT_NOT_IN_QUOTE",
    "PERIOD_NOT_IN_QUOTE",
)
CONTEXT = 120


def _like(text: Column, *parts) -> Column:
    """Whether a text matches a pattern built from literals and columns; columns are taken literally."""
    quoted = [F.concat(F.lit(r"\Q"), p, F.lit(r"\E")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.coalesce(F.rlike(text, F.concat(*quoted)), F.lit(False))


def heading_number(value: Column, quote: Column) -> Column:
    """Whether the value numbers a heading, section or list item of the quote."""
    v, q = plain_text(value), F.trim(quote)
    return _like(q, "^", v, r"\s*[.)-]") | _like(q, r"(?:^|[\n\r])\s*", v, r"\.\s+[A-Z]") | _like(q, rf"(?i)\b(?:{HEADING_WORDS})\s+", v, r"\b")


def year_or_date(value: Column, quote: Column) -> Column:
    """Whether the value is a calendar year or a day of a month in the quote."""
    v = plain_text(value)
    year = (
        _like(quote, rf"(?i)(?:{YEAR_WORDS})\s*,?\s*", v)
        | _like(quote, v, r"\s*[-–]\s*[0-9]{2,4}")
        | _like(quote, r"\b(?:19|20)[0-9]{2}\b")
        | _like(quote, rf"(?i)[0-9]+(?:st|nd|rd|th)?\s+(?:{X.MONTHS})[a-z]*[,\s]+", v)
        | _like(quote, v, r"\.")
    )
    day = _like(quote, r"(?i)\b", v, rf"(?:st|nd|rd|th)\s+(?:{X.MONTHS})")
    whole = value == F.floor(value)
    return F.coalesce(whole & F.when(value.between(1900, 2100), year).when(value.between(1, 31), day).otherwise(False), F.lit(False))


def page_number(value: Column, quote: Column, page: Column) -> Column:
    return F.coalesce(value == page, F.lit(False)) & _like(quote, r"(?i)\b(?:page|p\.|pg\.)\s*", plain_text(value), r"\b")


def value_in_quote(value: Column, quote: Column, normal: Column) -> Column:
    """Whether the quote holds the value: plain, or with thousands commas of either style."""
    bare = F.regexp_replace(normal, "([0-9]),([0-9])", "$1$2")
    v = plain_text(value)
    found = F.contains(bare, v) | F.contains(normal, grouped(value)) | F.contains(normal, grouped(value, indian=True)) | F.contains(normal, v) | F.contains(quote, v)
    return F.coalesce(found, F.lit(False))


def unit_in_quote(kind: Column, unit: Column, quote: Column, normal: Column) -> Column:
    u = F.lower(F.trim(unit))
    words = F.concat(
        F.array(u),
        F.when(u.isin("crore", "crores"), F.array(F.lit("cr"), F.lit("crore"))).otherwise(F.array().cast("array<string>")),
        F.when(u.isin("lakh", "lakhs"), F.array(F.lit("lakh"), F.lit("l"))).otherwise(F.array().cast("array<string>")),
        F.when(u.isin("percent", "percentage"), F.array(F.lit("%"), F.lit("percent"))).otherwise(F.array().cast("array<string>")),
        F.when(u.isin("km", "kilometer"), F.array(F.lit("km"), F.lit("kilometres"))).otherwise(F.array().cast("array<string>")),
        F.when(kind.isin(*MONEY_TYPES), F.array(*[F.lit(m) for m in MONEY_MARKS])).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.exists(words, lambda w: F.contains(F.lower(quote), w) | F.contains(F.lower(normal), w)), F.lit(False))


def period_near(period: Column, normal_quote: Column, normal_page: Column, start: Column, stop: Column) -> Column:
    """Whether the period stands in the quote or within 120 characters of it, in any of its dash spellings."""
    p = F.trim(period)
    spelled = F.transform(
        F.array(p, F.replace(p, F.lit("-"), F.lit("–")), F.replace(p, F.lit("–"), F.lit("-")), F.replace(p, F.lit("/"), F.lit("-")), F.replace(p, F.lit("/"), F.lit("–"))), F.lower
    )
    lo = F.greatest(F.lit(0), start - CONTEXT)
    near = F.substr(normal_page, lo + 1, F.least(F.length(normal_page), stop + CONTEXT) - lo)
    return F.coalesce(F.exists(spelled, lambda t: F.contains(normal_quote, t) | F.contains(near, t)), F.lit(False))


def verify_facts(facts: DataFrame, pages: DataFrame, check_units: bool = True) -> DataFrame:
    """`facts` (document_id, page, quote, value, type, unit, period) with verified, fail_reason, quote_matched,
    exact_match, proof_type and confidence.

    `pages` is (document_id, page, text). The first reason of REASONS that holds is given. `check_units=False`
    leaves out the two unit checks, as ingestion does. The normal forms of a page are made once, before its facts meet
    it, and only for pages that a fact cites; pages and facts are both large, so they meet in a shuffle by page.
    """
    at = ["document_id", "page"]
    cited = pages.select(*at, F.col("text").alias("page_text")).hint("merge").join(facts.select(*at).distinct(), at, "left_semi")
    cited = cited.withColumn("_cp", X.canonical(F.col("page_text"))).withColumn("_vp", X.spelled(F.col("_cp")))
    joined = facts.hint("merge").join(cited, at, "left").withColumn("_cq", X.canonical(F.col("quote"))).withColumn("_vq", X.spelled(F.col("_cq")))
    forms = (F.col("_cp"), F.col("_cq"), F.col("_vp"), F.col("_vq"))
    joined = joined.withColumn("_q", X.find_quote(F.col("page_text"), F.col("quote"), forms))
    tier = F.col("_q.tier")
    form = lambda *c: F.when(tier == "exact", c[0]).when(tier == "canonical", c[1]).when(tier == "lower", F.lower(c[1])).otherwise(c[2])
    joined = joined.withColumns({"_nq": form(F.col("quote"), F.col("_cq"), F.col("_vq")), "_np": form(F.col("page_text"), F.col("_cp"), F.col("_vp"))})
    v, q = F.col("value"), F.col("quote")
    finite = v.isNotNull() & ~F.isnan(v)
    typed = F.col("type").isin(*UNIT_TYPES) if check_units else F.lit(False)
    period = F.length(F.trim(F.coalesce(F.col("period"), F.lit("")))) > 0
    unit = F.length(F.trim(F.coalesce(F.col("unit"), F.lit("")))) > 0
    reason = (
        F.when(F.length(F.coalesce("page_text", F.lit(""))) == 0, REASONS[0])
        .when(~F.col("_q.matched"), REASONS[1])
        .when(finite & year_or_date(v, q), REASONS[2])
        .when(finite & heading_number(v, q), REASONS[3])
        .when(finite & page_number(v, q, F.col("page")), REASONS[4])
        .when(finite & ~value_in_quote(v, q, F.col("_nq")), REASONS[5])
        .when(typed & ~unit, REASONS[6])
        .when(typed & ~unit_in_quote(F.col("type"), F.col("unit"), q, F.col("_nq")), REASONS[7])
        .when(period & ~period_near(F.col("period"), F.col("_nq"), F.col("_np"), F.col("_q.start"), F.col("_q.stop")), REASONS[8])
    )
    out = joined.withColumns({"fail_reason": reason, "quote_matched": F.col("_q.matched"), "exact_match": F.col("_q.exact")})
    verified = F.col("fail_reason").isNull()
    proof = F.when(verified, "VERIFIED").when(F.col("fail_reason") == REASONS[0], "UNVERIFIABLE").otherwise("REJECTED")
    confidence = F.when(verified & F.col("exact_match"), 1.0).when(verified, 0.95).when(F.col("quote_matched") & (F.col("fail_reason") != REASONS[0]), 0.3).otherwise(0.0)
    return out.withColumns({"verified": verified, "proof_type": proof, "confidence": confidence}).drop("_q", "_nq", "_np", "_cp", "_cq", "_vp", "_vq", "page_text")


def reason_histogram(verified: DataFrame) -> DataFrame:
    return verified.groupBy(F.coalesce("fail_reason", F.lit("VERIFIED")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def verification_rate(verified: DataFrame) -> DataFrame:
    """proposed, verified and rate (0 for none)."""
    n, ok = F.count(F.lit(1)), F.count_if("verified")
    return verified.agg(n.alias("proposed"), ok.alias("verified"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("rate"))


def _standing(met: DataFrame, quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """The pairs of `met` whose quote stands in the page's text, with its start."""
    texts = met.join(quotes.select("quote_id", "quote"), "quote_id").join(pages.select("page_id", "text"), "page_id")
    return texts.select("page_id", "quote_id", (F.instr("text", F.col("quote")) - 1).alias("start")).filter("start >= 0")


def _short_quotes(pages: DataFrame, quotes: DataFrame, letters: int = 3) -> DataFrame:
    """Quotes without an inner word, whose parts may be pieces of a page's words: words that hold the longest part are
    found among the distinct words of all pages, by its first letters, and lead to their pages."""
    longest = F.array_max(F.transform("parts", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = quotes.withColumn("part", longest).withColumn("key", F.substring(F.col("part"), 1, letters))
    words = pages.select("page_id", F.explode_outer(F.array_distinct("w")).alias("word")).filter("word <> ''")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - n + 1)), lambda i: F.substring(F.col("word"), i, F.lit(n)))
    known = words.select("word").distinct().select("word", F.explode_outer(F.array_distinct(F.concat(*[pieces(n) for n in range(1, letters + 1)]))).alias("key"))
    hits = known.join(q.select("quote_id", "part", "key"), "key").filter(F.contains("word", F.col("part"))).select("word", "quote_id")
    return _standing(words.join(hits, "word").select("page_id", "quote_id").distinct(), q, pages)


def quotes_on_pages(pages: DataFrame, quotes: DataFrame, words: int = 4) -> DataFrame:
    """(page_id, quote_id, start) of each quote that stands verbatim on a page.

    A quote's inner words are whole words of any page that holds it. Pages and quotes meet on one run of `words` inner
    words, a shorter run for shorter quotes: the one that fewest pages hold, as its frequency over all pages says, so
    frequent runs meet no one. Only the runs that quotes hold leave a page; those are told by a semi join with the
    distinct runs of all quotes. Quotes of one or two words have no inner word: their longest part meets the distinct
    words of all pages by its first letters. Blank quotes stand on no page.
    """
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - n + 1)), lambda i: F.array_join(F.slice(c, i, n), " "))
    q = quotes.filter(F.rlike("quote", F.lit(r"\S"))).withColumn("w", F.split("quote", r"\s+")).withColumn("parts", F.col("w"))
    q = q.withColumn("w", F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 2))).withColumn("n", F.least(F.lit(words), F.size("w")))
    sizes = [r["n"] for r in q.select("n").distinct().collect()]  # at most `words` + 1 values
    inner = q.filter("n > 0").withColumn("key", F.explode_outer(F.array_distinct(runs(F.col("w"), F.col("n"))))).select("quote_id", "n", "key")
    p = pages.withColumn("w", F.split("text", r"\s+"))
    sized = lambda n: F.transform(F.array_distinct(runs(F.col("w"), n)), lambda r: F.struct(F.lit(n).alias("n"), r.alias("key")))
    kinds = [sized(n) for n in sorted(sizes) if n > 0]
    found = [_short_quotes(p, q.filter("n = 0"))] if 0 in sizes else []
    if kinds:
        held = p.select("page_id", F.explode_outer(F.concat(*kinds)).alias("r")).select("page_id", "r.n", "r.key")
        held = held.join(inner.select("n", "key").distinct(), ["n", "key"], "left_semi")
        at = fresh_dir(pages.sparkSession, "runs")
        held.write.parquet(at)  # counted and met: one pass over the texts for both
        held = pages.sparkSession.read.parquet(at)
        often = held.groupBy("n", "key").agg(F.count(F.lit(1)).alias("pages"))
        rarest = inner.join(often, ["n", "key"], "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "n", "key")).alias("r"))
        met = rarest.filter("r.pages > 0").select("quote_id", "r.n", "r.key").join(held, ["n", "key"]).select("page_id", "quote_id")
        found.append(_standing(met, q, pages))
    if not found:
        return pages.select("page_id", F.lit(None).cast("long").alias("quote_id"), F.lit(0).alias("start")).limit(0)
    return reduce(DataFrame.unionByName, found)
