"""Documents as a library: visibility, integrity, filters, totals, and evaluation of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Status groups, page limits and the precision that passes.
STATUS_GROUPS = {"ready": ("done", "ready"), "failed": ("failed",)}
DEFAULT_PAGE, MOST_PAGE = 20, 100
PASSING_PRECISION = 0.99
SORTS = {"newest": [F.desc], "oldest": [F.asc]}


def visible(documents: DataFrame, owner_id) -> DataFrame:
    """Documents of an owner, and samples."""
    return documents.filter((F.col("owner_id") == F.lit(owner_id)) | F.coalesce("is_sample", F.lit(False)))


def visible_children(children: DataFrame, documents: DataFrame, owner_id, key: str = "document_id") -> DataFrame:
    """Rows whose document the owner may see."""
    return children.join(visible(documents, owner_id).select(key), key, "left_semi")


def orphans(children: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows that a cascade removes: their document is gone."""
    return children.join(documents.select(key), key, "left_anti")


def surviving(children: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    return children.join(documents.select(key), key, "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key: the read side of append-only updates."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def new_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads (owner_id, sha256, …) whose content the owner has not stored yet, once each."""
    keys = ["owner_id", "sha256"]
    return uploads.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def page_of(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return rows.limit(min(limit or DEFAULT_PAGE, MOST_PAGE))


def search_library(documents: DataFrame, text: str = "", status: str = "all", extensions: tuple[str, ...] = (), sort: str = "newest") -> DataFrame:
    """Documents by name or id, status group and extension, sorted newest, oldest, name or size."""
    out = documents
    if text:
        out = out.filter(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower(F.col("document_id").cast("string")), F.lit(text.lower())))
    if status in STATUS_GROUPS:
        out = out.filter(F.col("status").isin(*STATUS_GROUPS[status]))
    elif status == "processing":
        out = out.filter(~F.col("status").isin(*[s for g in STATUS_GROUPS.values() for s in g]))
    if extensions:
        out = out.filter(F.regexp_extract(F.lower("name"), r"\.([a-z0-9]+)$", 1).isin(*extensions))
    order = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "name": F.asc("name"), "size": F.desc("size_bytes")}[sort]
    return out.orderBy(order, "document_id")


def library_totals(documents: DataFrame) -> DataFrame:
    ready, failed = F.col("status").isin(*STATUS_GROUPS["ready"]), F.col("status").isin(*STATUS_GROUPS["failed"])
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"), F.count_if(ready).alias("ready"), F.count_if(failed).alias("failed"), F.count_if(~ready & ~failed).alias("processing"))


def filter_facts(facts: DataFrame, text: str = "", semantic: str | None = None, proof: str | None = None, page: int | None = None) -> DataFrame:
    """Facts by text (in label, quote or value), semantic type, proof ('needs_review' for any below verified) and page."""
    from factloom.functions.numbers import plain_text
    from factloom.operators.facts import effective_proof, semantic_type

    out = facts
    if text:
        t = F.lit(text.lower())
        hit = F.contains(F.lower("label"), t) | F.contains(F.lower("quote"), t) | F.coalesce(F.contains(plain_text(F.col("value")), t), F.lit(False))
        out = out.filter(hit)
    if semantic:
        out = out.filter(semantic_type(F.col("type")) == semantic)
    if proof == "needs_review":
        out = out.filter(~effective_proof().isin("VERIFIED", "VERIFIED_OCR", "COMPUTED", "USER_CONFIRMED"))
    elif proof:
        out = out.filter(effective_proof() == proof)
    return out.filter(F.col("page") == page) if page is not None else out


def extraction_scores(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """sample_id, precision, recall, f1 and passed; empty denominators count as 1.

    `extracted` is (sample_id, label, verified); an expected label is found where a verified fact has it, in any case.
    """
    facts = extracted.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("ok"))
    hit = expected.withColumn("k", F.lower("label")).join(extracted.filter("verified").select("sample_id", F.lower("label").alias("k")).distinct(), ["sample_id", "k"], "left_semi")
    wanted = expected.groupBy("sample_id").agg(F.count(F.lit(1)).alias("wanted"))
    found = hit.groupBy("sample_id").agg(F.count(F.lit(1)).alias("found"))
    rows = wanted.join(found, "sample_id", "left").join(facts, "sample_id", "full").na.fill(0)
    p, r = F.coalesce(F.try_divide("ok", "n"), F.lit(1.0)), F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0))
    return rows.select("sample_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), (p >= PASSING_PRECISION).alias("passed"))


def modality_sweep(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """modality, mean_precision, passed and n of scored samples (sample_id, modality)."""
    return scores.join(samples, "sample_id").groupBy("modality").agg(F.avg("precision").alias("mean_precision"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("n"))


def gold_hits(gold: DataFrame, facts: DataFrame, gap: float = 0.01) -> DataFrame:
    """Gold items (item_id, page, expected) that some fact on their page meets: within `gap`, or any where none is expected."""
    near = F.col("expected").isNull() | (F.abs(F.col("value") - F.col("expected")) < gap)
    return gold.join(facts.select(F.col("page").alias("p"), "value"), (F.col("page") == F.col("p")) & near, "left_semi")


def recall_at(ranked: DataFrame, gold: DataFrame, k: int = 8, window: int = 1) -> DataFrame:
    """recall: the share of questions (question_id, page) with a chunk of their page, or one page off, in their first k."""
    hits = ranked.filter(F.col("rank") <= k).join(gold.withColumnRenamed("page", "gold_page"), "question_id").filter(F.abs(F.col("page") - F.col("gold_page")) <= window).select("question_id").distinct()
    marked = gold.join(hits.withColumn("hit", F.lit(1)), "question_id", "left")
    return marked.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
