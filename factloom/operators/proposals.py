"""Proposed facts: prompts for page chunks, recorded answers, normal forms, and figures read off plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators.facts import semantic_type

# The order in which recordings are looked up, and the figures read off sentences.
REPLAY_KEYS = ("path", "document_chunk", "chunk", "document", "sha")
FIGURE = r"(?i)((?:rs\.?|₹|inr)?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:crores?|lakhs?|million|thousand|km|%|percent))"
FIGURE_PARTS = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|lakhs?|million|thousand|km|%|percent)"
QUOTE_MARGIN = 40
ANSWER = "array<struct<factType:string,type:string,label:string,value:double,unit:string,currency:string,period:string,page:int,quote:string>>"


def prompts(chunks: DataFrame, instructions: str) -> DataFrame:
    """Chunks (document_id, chunk, texts) with prompt and prompt_hash."""
    prompt = F.concat_ws("\n\n", F.lit(instructions), F.array_join("texts", "\n\n"))
    return chunks.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))


def replay(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Chunks with the answer recorded under the first of their keys that has one, and key_used; null without any.

    Chunks have document_id, chunk, chunk_hash, sha and path; recordings are (kind, key, answer).
    """
    keys = {
        "path": F.col("path"),
        "document_chunk": F.concat_ws("_", F.col("document_id").cast("string"), "chunk_hash"),
        "chunk": F.col("chunk_hash"),
        "document": F.col("document_id").cast("string"),
        "sha": F.col("sha"),
    }
    tried = chunks.select("document_id", "chunk", F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(k).alias("kind"), keys[k].alias("key")) for i, k in enumerate(REPLAY_KEYS)])).alias("t")).select("document_id", "chunk", "t.*")
    found = tried.join(recordings, ["kind", "key"]).groupBy("document_id", "chunk").agg(F.min_by(F.struct("answer", "kind"), "nth").alias("a"))
    return chunks.join(found, ["document_id", "chunk"], "left").select(*chunks.columns, F.col("a.answer").alias("answer"), F.col("a.kind").alias("key_used"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """One row a proposed fact of JSON answers (document_id, chunk, answer), fenced or not; broken answers give none."""
    facts = answers.select("document_id", "chunk", F.explode(F.from_json(X.strip_json_fence(F.col("answer")), ANSWER)).alias("f")).select("document_id", "chunk", "f.*")
    return normalize(facts)


def normalize(facts: DataFrame) -> DataFrame:
    """Proposals with fact_type, a label and a page for all, and empty units, currencies and periods as null."""
    kind = F.coalesce(F.nullif("factType", F.lit("")), semantic_type(F.col("type")))
    page = F.when(F.coalesce("page", F.lit(0)) > 0, F.col("page")).otherwise(1)
    label = F.coalesce(F.nullif("label", F.lit("")), F.concat(kind, F.lit(" on page "), page.cast("string")))
    return facts.select("document_id", "chunk", kind.alias("fact_type"), label.alias("label"), "value", *[F.nullif(c, F.lit("")).alias(c) for c in ("unit", "currency", "period")], page.alias("page"), F.coalesce("quote", F.lit("")).alias("quote"))


def figures_in_text(pages: DataFrame) -> DataFrame:
    """document_id, page, pos, value, unit, basis, fiscal_year and quote of each figure with a unit in a page's sentences.

    The quote is the figure with up to 40 characters on either side of it; a page's value and quote count once.
    """
    rows = pages.select("document_id", "page", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.select("document_id", "page", "pos", "sentence", F.posexplode(F.regexp_extract_all("sentence", F.lit(FIGURE), 1)).alias("nth", "figure"))
    number = F.replace(F.regexp_extract("figure", FIGURE_PARTS, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_replace(F.lower(F.regexp_extract("figure", FIGURE_PARTS, 2)), "s$", "")
    at = F.instr("sentence", F.col("figure"))
    lo = F.greatest(F.lit(1), at - QUOTE_MARGIN)
    quote = F.trim(F.substr("sentence", lo, at + F.length("figure") + QUOTE_MARGIN - lo))
    basis = F.when(F.col("sentence").rlike(r"(?i)\bBE\b|budget estimate"), "BE").when(F.col("sentence").rlike(r"(?i)\bRE\b|revised estimate"), "RE").when(F.col("sentence").rlike("(?i)actual"), "actual").otherwise("none")
    year = F.nullif(F.regexp_extract("sentence", r"(20[0-9]{2}\s*[-–]\s*[0-9]{2,4})", 1), F.lit(""))
    out = rows.select("document_id", "page", "pos", "nth", number.alias("value"), unit.alias("unit"), basis.alias("basis"), year.alias("fiscal_year"), quote.alias("quote")).filter("value is not null")
    first = F.row_number().over(Window.partitionBy("document_id", "page", "value", F.lower("quote")).orderBy("pos", "nth"))
    return out.withColumn("n", first).filter("n = 1").drop("n", "nth")


def plain_value(value: Column, unit: Column) -> Column:
    """A proposed value as a plain number."""
    return N.indian_scale(value, unit)
