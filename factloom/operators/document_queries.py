"""Driver queries of text, verification and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import search as S
from factloom.operators import verify as V
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CANON = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '([a-zA-Z]{{2,}})-\s+([a-zA-Z]{{2,}})', '\1\2', 'g'), '[\r\n\t\f\x0B\x{{A0}}]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, md5({_CANON.format('text')}) AS form FROM documents")
def normalize_canonical(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.canonical(F.col("text"))).alias("form"))


@query(
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower({_CANON.format("text")}), 'rs\\.?|inr', 'rs', 'g'), '\\bcrores?\\b|\\bcr\\b', 'crore', 'g'), '\\blakhs?\\b|\\bl\\b', 'lakh', 'g')) AS form
FROM documents"""
)
def normalize_verification(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.verification_form(F.col("text"))).alias("form"))


@query("SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return V.quotes_on_pages(docs, quotes).select(F.col("page_id").alias("doc_id"), F.col("quote_id").alias("item_id"), F.col("start").cast("long").alias("start"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"


# Planted openings of a page by case: a heading number, a year, a page number, grouped values, a period.
_OPENINGS = {1: "9. ", 6: "Report of march 2024. ", 7: "See page 1 for totals. ", 8: "Total Rs. 12,34,567 crore. ", 9: "FY 2026–27 outlay: "}


def _proposals(spark, sf_dir):
    """Proposed facts over documents as pages: a stretch of the page as quote (or a stranger's), with a planted value."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    k = F.when((d % 5 == 0) & (d % 6 != 0), 6 + d % 4).otherwise(d % 6)
    opening = F.lit("")
    for digit, words in _OPENINGS.items():
        opening = F.when(k == digit, words).otherwise(opening)
    opening = F.when((k == 8) & (d % 8 == 6), "Total Rs. 1,234,567 crore. ").otherwise(opening)
    text = F.concat(opening, F.col("text"))
    quote = (
        F.when(k == 0, F.substring("text", 11, 40))
        .when(k == 1, F.concat(F.lit("9. "), F.substring("text", 1, 30)))
        .when(k == 2, F.translate(F.substring("text", 5, 40), _SMALL, _SMALL.upper()))
        .when(k == 3, F.substring("text", 3, 30))
        .when(k == 4, F.substring("text", 1, 50))
        .when(k == 5, F.substring("text", 20, 20))
        .when(k == 6, "of march 2024")
        .when(k == 7, "See page 1 for")
        .when(k == 8, F.substring(text, 1, 20))
        .otherwise(F.concat(F.lit("outlay: "), F.substring("text", 1, 20)))
    )
    page = F.when(d % 11 == 0, 2).otherwise(1)
    value = F.when(k == 1, 9.0).when(k == 3, 77123.0).when(k == 6, 2024.0).when(k == 7, 1.0).when(k == 8, 1234567.0)
    facts = docs.select(
        F.col("doc_id").alias("document_id"), page.alias("page"), quote.alias("quote"), value.cast("double").alias("value"),
        F.when(k.isin(4, 8), "allocation").otherwise("statistic").alias("type"), F.when((k == 8) | (d % 12 == 4), "crore").alias("unit"),
        F.when(k.isin(5, 9), "2026-27").alias("period"),
    )
    return facts, docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), text.alias("text"))


_CHAIN = """WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 AND doc_id % 6 <> 0 THEN 6 + doc_id % 4 ELSE doc_id % 6 END AS k FROM documents),
p AS (SELECT doc_id, k, CASE WHEN k = 8 AND doc_id % 8 = 6 THEN 'Total Rs. 1,234,567 crore. ' ELSE CASE k WHEN 1 THEN '9. ' WHEN 6 THEN 'Report of march 2024. '
  WHEN 7 THEN 'See page 1 for totals. ' WHEN 8 THEN 'Total Rs. 12,34,567 crore. ' WHEN 9 THEN 'FY 2026–27 outlay: ' ELSE '' END END || text AS page_text, text FROM b),
f AS (SELECT *, CASE k WHEN 0 THEN substr(text, 11, 40) WHEN 1 THEN '9. ' || substr(text, 1, 30) WHEN 2 THEN translate(substr(text, 5, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 3 THEN substr(text, 3, 30)
  WHEN 4 THEN substr(text, 1, 50) WHEN 5 THEN substr(text, 20, 20) WHEN 6 THEN 'of march 2024' WHEN 7 THEN 'See page 1 for' WHEN 8 THEN substr(page_text, 1, 20) ELSE 'outlay: ' || substr(text, 1, 20) END AS quote FROM p),
v AS (SELECT doc_id AS document_id, CASE
  WHEN doc_id % 11 = 0 OR coalesce(page_text, '') = '' THEN 'PAGE_TEXT_MISSING'
  WHEN coalesce(quote, '') = '' OR NOT (contains(page_text, quote) OR contains({pc}, {qc}) OR contains(lower({pc}), lower({qc}))) THEN 'QUOTE_NOT_ON_SINGLE_PAGE'
  WHEN k = 6 THEN 'YEAR_OR_DATE_AS_VALUE'
  WHEN k = 1 THEN 'HEADING_NUMBER'
  WHEN k = 7 THEN 'PAGE_OR_ID_NUMBER'
  WHEN k = 3 AND NOT contains(quote, '77123') OR k = 8 AND NOT contains(replace(quote, ',', ''), '1234567') THEN 'VALUE_NOT_IN_QUOTE'
  WHEN k = 4 AND doc_id % 12 <> 4 THEN 'MISSING_REQUIRED_UNIT'
  WHEN k IN (4, 8) AND NOT (contains(lower(quote), 'cr') OR contains(lower(quote), 'rs') OR contains(lower(quote), 'inr')) THEN 'UNIT_NOT_IN_QUOTE'
  WHEN k = 5 AND NOT contains(page_text, '2026-27') THEN 'PERIOD_NOT_IN_QUOTE' END AS fail_reason FROM f)
""".format(pc=_CANON.format("page_text"), qc=_CANON.format("quote"))


@query(_CHAIN + "SELECT document_id, fail_reason IS NULL AS verified, fail_reason, CASE WHEN fail_reason IS NULL THEN 'VERIFIED' WHEN fail_reason = 'PAGE_TEXT_MISSING' THEN 'UNVERIFIABLE' ELSE 'REJECTED' END AS proof_type FROM v")
def verify_facts_chain(spark, sf_dir):
    return V.verify_facts(*_proposals(spark, sf_dir)).select("document_id", "verified", "fail_reason", "proof_type")


@query(_CHAIN + "SELECT coalesce(fail_reason, 'VERIFIED') AS outcome, count(*)::BIGINT AS n FROM v GROUP BY 1")
def fail_reason_histogram(spark, sf_dir):
    return V.reason_histogram(V.verify_facts(*_proposals(spark, sf_dir)))


@query(_CHAIN + "SELECT count(*)::BIGINT AS proposed, count(*) FILTER (fail_reason IS NULL)::BIGINT AS verified, avg((fail_reason IS NULL)::INT) AS rate FROM v")
def verification_rate(spark, sf_dir):
    return V.verification_rate(V.verify_facts(*_proposals(spark, sf_dir)))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20)) AS content,
  generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20), 1) AS pos FROM documents),
a AS (SELECT doc_id, content, pos - 1 AS chunk_index FROM l UNION ALL
  SELECT doc_id, text, 0 FROM documents WHERE len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20)) = 0)
SELECT doc_id AS document_id, chunk_index::INT AS chunk_index, md5(content) AS content FROM a"""
)
def chunk_lines(spark, sf_dir):
    return S.chunk_paragraphs(_pages(spark, sf_dir), "\n").select("document_id", "chunk_index", F.md5("content").alias("content"))


@query(
    """WITH r AS (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 1000.0))::BIGINT)) AS i FROM documents)
SELECT doc_id AS document_id, i::INT AS chunk_index, md5(substr(text, i * 1000 + 1, 1000)) AS content FROM r"""
)
def chunk_windows1000(spark, sf_dir):
    return S.chunk_windows(_pages(spark, sf_dir)).select("document_id", "chunk_index", F.md5("content").alias("content"))


@query()
def greedy_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.floor(F.col("doc_id") / 10).alias("document_id"), (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    return S.pack_pages(pages, 4, 8000)


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2)"


@query(
    f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INT % 768 AS bucket, (CASE WHEN ('0x' || substr(md5(w), 5, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) * (1 + ln(1 + length(w)::DOUBLE)) AS x FROM w),
e AS (SELECT doc_id, bucket, sum(x) AS x FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, bucket, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0) AS weight FROM e)
SELECT doc_id, count(*)::BIGINT AS entries, round(sum(weight * bucket), 4) AS moment FROM n GROUP BY 1"""
)
def hashed_embedding(spark, sf_dir):
    weights = S.hashed_weights(table(spark, sf_dir, "documents"), "doc_id")
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum(F.col("weight") * F.col("bucket")), 4).alias("moment"))


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


_COS = "SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, round(similarity, 6) AS similarity FROM ({_COS}) ORDER BY similarity DESC, vec_id LIMIT 8")
def cosine_topk(spark, sf_dir):
    return S.vector_top(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id").withColumn("similarity", F.round("similarity", 6))


_WORDS = "the thing and ontion ering"
_KEY = f"""SELECT doc_id, len(list_distinct(f))::INT AS matched, len(f)::INT AS hits FROM (
  SELECT doc_id, list_filter({_TOKENS}, lambda x: list_contains(['the', 'thing', 'and', 'ontion', 'ering'], x)) AS f FROM documents) WHERE len(f) > 0"""


@query(_KEY + " ORDER BY matched DESC, hits DESC, doc_id LIMIT 8")
def keyword_topk(spark, sf_dir):
    return S.keyword_top(table(spark, sf_dir, "documents"), _WORDS, "doc_id")


@query(
    f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM ({_COS}) ORDER BY r LIMIT 20),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY matched DESC, hits DESC, doc_id) AS r FROM ({_KEY}) ORDER BY r LIMIT 20)
SELECT id, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0), 8) AS score FROM v FULL JOIN k USING (id) ORDER BY score DESC, id LIMIT 8"""
)
def rrf_hybrid(spark, sf_dir):
    vector = S.vector_top(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(spark, sf_dir), "id", top=S.ARM_TOP)
    words = S.keyword_top(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), _WORDS, "id", top=S.ARM_TOP)
    fused = S.fuse(S.ranked(vector, F.desc("similarity"), F.col("id")), S.ranked(words, F.desc("matched"), F.desc("hits"), F.col("id")), "id")
    return fused.withColumn("score", F.round("score", 8))


@query(
    f"""WITH w AS (SELECT unnest(list_distinct({_TOKENS})) AS word FROM documents)
SELECT word, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) + 1, 8) AS idf FROM w GROUP BY 1"""
)
def corpus_idf(spark, sf_dir):
    return S.corpus_idf(table(spark, sf_dir, "documents"), "doc_id").withColumn("idf", F.round("idf", 8))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'gsk_[0-9A-Za-z_-]*', '[REDACTED_GSK]', 'g'), 'AIza[0-9A-Za-z_-]{20,}', '[REDACTED_AIZA]', 'g')) AS scrubbed FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' gsk_' || doc_id ELSE text || ' AIza' || repeat('x', 20) || ' end' END AS text FROM documents)"""
)
def secret_scrub(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" gsk_"), F.col("doc_id").cast("string"))).otherwise(F.concat("text", F.lit(" AIza" + "x" * 20 + " end")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.scrub_secrets(text)).alias("scrubbed"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(t, 'budget|expenditure|receipts|outlay|fiscal', 'i') THEN 'budget' WHEN regexp_matches(t, 'audit|comptroller|auditor', 'i') THEN 'audit'
  WHEN regexp_matches(t, 'policy|guidelines|framework', 'i') THEN 'policy' ELSE 'general' END AS kind FROM (
  SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Budget' WHEN 1 THEN ' AUDITOR' WHEN 2 THEN ' Framework' ELSE '' END AS t FROM documents)"""
)
def document_class(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.concat("text", F.when(k == 0, " Budget").when(k == 1, " AUDITOR").when(k == 2, " Framework").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.document_class(text).alias("kind"))


@query(
    r"""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(replace(text, ',', ''), '[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?'), lambda x: try_cast(x AS DOUBLE)) AS v FROM documents)
SELECT doc_id, len(v)::INT AS n, round(coalesce(list_sum(list_filter(v, lambda x: abs(x) < 1e9)), 0), 3) AS total FROM n"""
)
def number_extraction(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", N.extract_numbers(F.coalesce("text", F.lit(""))).alias("v"))
    small = F.filter("v", lambda x: F.abs(x) < 1e9)
    return found.select("doc_id", F.size("v").alias("n"), F.round(F.aggregate(small, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(
    """WITH o AS (SELECT o_orderkey, [(o_orderkey % 7)::DOUBLE, (o_custkey % 11)::DOUBLE, 20.0::DOUBLE] AS v, (o_orderkey % 40)::DOUBLE AS t FROM orders)
SELECT o_orderkey, t IN (v[1], v[2], v[3], v[1] + v[2], v[1] + v[3], v[2] + v[3], v[1] + v[2] + v[3]) AS grounded FROM o"""
)
def subset_sum_grounding(spark, sf_dir):
    v = F.array((F.col("o_orderkey") % 7).cast("double"), (F.col("o_custkey") % 11).cast("double"), F.lit(20.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.matches_subset_sum((F.col("o_orderkey") % 40).cast("double"), v, 0.0).alias("grounded"))


@query(
    f"""WITH d AS (SELECT doc_id, text, list_distinct({_TOKENS}) AS ref FROM documents),
c AS (SELECT doc_id, ref, list_distinct(list_filter(string_split_regex(regexp_replace(lower(substr(text, 1, 60) || ' unheard words'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)) AS own FROM d)
SELECT doc_id, round(len(list_intersect(own, ref)) / len(own)::DOUBLE, 6) AS overlap FROM c"""
)
def token_overlap(spark, sf_dir):
    claim = F.concat(F.substring("text", 1, 60), F.lit(" unheard words"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.token_overlap(claim, F.col("text")), 6).alias("overlap"))


