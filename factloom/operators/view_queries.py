"""Driver queries of the document views and the ingest job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import document_queries as D
from factloom.operators import layout as L
from factloom.operators import search as S
from factloom.operators import views as W
from factloom.operators import world_queries as Q
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
    """lineitem as facts of their orders' customers' documents, with every proof type and some reasons."""
    k = F.col("l_partkey") % 8
    proof = F.element_at(F.array(*[F.lit(p) for p in (*W.PROOFS, "REJECTED", "UNVERIFIABLE")]), (k + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        F.concat(F.lit("Label "), F.col("l_returnflag")).alias("label"), F.lower("l_linestatus").alias("type"), proof.alias("proof_type"), (k < 6).alias("verified"),
        F.when(k == 6, "VALUE_NOT_IN_QUOTE").alias("fail_reason"),
    )


_FACTS = """WITH f AS (SELECT l_suppkey AS document_id, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS fact_id, 'Label ' || l_returnflag AS label, lower(l_linestatus) AS type, l_partkey % 8 AS k,
['VERIFIED', 'VERIFIED_OCR', 'COMPUTED', 'DERIVED', 'USER_CONFIRMED', 'ESTIMATED', 'REJECTED', 'UNVERIFIABLE'][l_partkey % 8 + 1] AS proof_type FROM lineitem)
"""


@query(_FACTS + "SELECT document_id, count(*) FILTER (k < 6)::BIGINT AS verified, count(*) FILTER (k = 6)::BIGINT AS failed, count(*) FILTER (k = 7)::BIGINT AS unverified, count(DISTINCT page)::BIGINT AS pages FROM f GROUP BY 1")
def viewer_counts(spark, sf_dir):
    return W.viewer_counts(_facts(spark, sf_dir))


@query(_FACTS + "SELECT document_id, page, count(*)::BIGINT AS facts, count(*) FILTER (k < 6)::BIGINT AS verified FROM f GROUP BY 1, 2")
def page_histogram(spark, sf_dir):
    return W.page_histogram(_facts(spark, sf_dir))


@query(_FACTS + "SELECT d.document_id, p.proof, (SELECT count(*) FROM f WHERE f.document_id = d.document_id AND f.proof_type = p.proof)::BIGINT AS n FROM (SELECT DISTINCT document_id FROM f) d, (SELECT unnest(['VERIFIED', 'VERIFIED_OCR', 'COMPUTED', 'DERIVED', 'USER_CONFIRMED', 'ESTIMATED']) AS proof) p")
def proof_counts(spark, sf_dir):
    return W.proof_counts(_facts(spark, sf_dir))


@query(_FACTS + "SELECT document_id, fact_id, label FROM f WHERE contains(lower(label), 'r') OR type = 'R'")
def category_filter(spark, sf_dir):
    return W.in_category(_facts(spark, sf_dir), "R").select("document_id", "fact_id", "label")


@query("SELECT p_partkey, p_name AS term FROM part WHERE contains(lower(p_name), 'ec') OR contains(lower(p_type), 'ec')")
def glossary_search(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"), F.col("p_type").alias("definition"))
    return W.search_glossary(terms, "EC").select("p_partkey", "term")


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    """part and n: the rows of each DataFrame."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return reduce(DataFrame.unionAll, each)


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'resolved' END AS part, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def review_split(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"))
    return _counts(W.split_reviews(items))


@query(
    """WITH c AS (SELECT ps % 5 = 0 AS chart, ps % 10 = 0 AS labelled, (ps % 101)::DOUBLE AS confidence FROM (SELECT p_partkey AS ps FROM part)),
r AS (SELECT NOT (chart AND NOT labelled) AND confidence >= 80 AS ok, chart AND NOT labelled OR confidence < 80 AS review FROM c)
SELECT 'all' AS part, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'verified', count(*) FILTER (ok) FROM r UNION ALL SELECT 'review', count(*) FILTER (review) FROM r"""
)
def ocr_page_split(spark, sf_dir):
    k = F.col("p_partkey")
    scored = table(spark, sf_dir, "part").select(k.alias("candidate_id"), (k % 101).cast("double").alias("confidence"), (k % 5 == 0).alias("is_chart_element"), (k % 10 == 0).alias("has_verified_label"))
    return _counts(W.split_page_facts(L.route_candidates(scored)))


@query(_FACTS + "SELECT document_id, page, fact_id, row_number() OVER (PARTITION BY document_id ORDER BY page, fact_id)::INT AS place FROM f WHERE document_id = 3")
def fact_listing(spark, sf_dir):
    one = W.of_document(_facts(spark, sf_dir), 3)
    rows = W.listing(one, "facts").agg(F.collect_list(F.struct("document_id", "page", "fact_id")).alias("r"))  # the facts of one document
    return rows.select(F.posexplode("r").alias("place", "x")).select("x.document_id", "x.page", "x.fact_id", (F.col("place") + 1).alias("place"))


@query(
    """WITH c AS (SELECT n_nationkey AS document_id, unnest(range(1, 9)) AS r FROM nation)
SELECT document_id, 'kind' || (r * 5 % 8) AS kind, r AS rank, p.pos FROM c, (SELECT unnest(range(2)) AS pos) p WHERE r <= 6"""
)
def chart_limit(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("rank"))
    c = c.select("document_id", F.concat(F.lit("kind"), (F.col("rank") * 5 % 8).cast("string")).alias("kind"), "rank", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"))
    return W.top_candidates(c, W.MOST_SHOWN).select("document_id", "kind", "rank", "pos")


@query(
    """WITH s AS (SELECT p_partkey % 4 AS modality, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.99 + (p_partkey % 3) / 100.0 - 0.01 END::DOUBLE AS precision, CASE p_partkey % 4 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS grounding, p_partkey % 4 <> 2 AS passed FROM part)
SELECT modality, count(*)::BIGINT AS samples, count(*) FILTER (passed)::BIGINT AS passed, round(avg(precision), 8) AS precision, round(avg(grounding), 8) AS grounding, avg(precision) >= 0.99 AND avg(grounding) >= 1.0 AND bool_and(passed) AS meets FROM s GROUP BY 1"""
)
def modality_summary(spark, sf_dir):
    k = F.col("p_partkey")
    precision = F.when(k % 4 == 0, 1.0).otherwise(0.99 + (k % 3) / 100.0 - 0.01)
    s = table(spark, sf_dir, "part").select((k % 4).alias("modality"), precision.alias("precision"), F.when(k % 4 == 1, 0.5).otherwise(1.0).alias("grounding"), (k % 4 != 2).alias("passed"))
    return W.modality_summary(s).withColumns({"precision": F.round("precision", 8), "grounding": F.round("grounding", 8)})


@query(
    """WITH i AS (SELECT p_partkey, p_partkey % 7 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/tiff' WHEN 4 THEN 'image/jpeg' WHEN 5 THEN NULL ELSE 'image/png' END AS mime,
  CASE WHEN p_partkey % 11 = 0 THEN 'FILE_TOO_LARGE' WHEN k = 5 THEN 'UNSUPPORTED_FORMAT' WHEN k = 6 THEN 'IMAGE_DIMENSIONS_EXCEEDED' END AS reason, k = 4 AS has_exif FROM i"""
)
def image_guard(spark, sf_dir):
    k = F.col("p_partkey") % 7
    heads = ("89504E470D0A1A0A00000000", "FFD8FFE000104A464946", "524946460000000057454250", "49492A0008000000", "FFD8FFE1001045786966", "68656C6C6F", "89504E470D0A1A0A00000000")
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (k + 1).cast("int")))
    size = F.when(F.col("p_partkey") % 11 == 0, W.IMAGE_BYTES + 1).otherwise(F.length(content))
    guard = W.image_guard(content, size, F.when(k == 6, 8001).otherwise(1200), F.lit(1600))
    return table(spark, sf_dir, "part").select("p_partkey", guard.alias("g")).select("p_partkey", "g.*")


@query(_FACTS + """, d AS (SELECT s_suppkey AS document_id, s_name AS filename FROM supplier), a AS (SELECT document_id, count(*) AS facts, count(*) FILTER (k < 6) AS verified, count(*) FILTER (k = 5) AS pending, count(*) FILTER (k = 6) AS conflicts, count(*) FILTER (page = 1) AS terms FROM f GROUP BY 1)
SELECT document_id, '{"document_id":' || document_id || ',"filename":"' || filename || '","facts":' || coalesce(facts, 0) || ',"verified":' || coalesce(verified, 0) || ',"pending":' || coalesce(pending, 0) || ',"conflicts":' || coalesce(conflicts, 0) || ',"terms":' || coalesce(terms, 0) || '}' AS dossier FROM d LEFT JOIN a USING (document_id)""")
def audit_dossier(spark, sf_dir):
    facts = W.facts_view(_facts(spark, sf_dir))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("filename"))
    reviews = facts.select("document_id", F.when(F.col("proof_type") == "ESTIMATED", "pending").otherwise("approved").alias("status"))
    return W.audit_dossier(docs, facts, reviews, facts.filter("proof_type = 'REJECTED'"), facts.filter("page = 1"))


@query(
    f"""WITH o AS ({Q._MONEY_LINES}),
b AS (SELECT *, min(line) OVER w AS top, max(line) OVER w AS bottom FROM o WINDOW w AS (PARTITION BY document_id, page)),
p AS (SELECT document_id, count(DISTINCT page) AS pages FROM b GROUP BY 1), t AS (SELECT document_id, trim(text) AS text, count(*) AS n FROM b WHERE line = top GROUP BY 1, 2), r AS (SELECT document_id, trim(text) AS text, count(*) AS n FROM b WHERE line = bottom AND bottom > top GROUP BY 1, 2),
kept AS (SELECT b.* FROM b JOIN p USING (document_id) LEFT JOIN t ON t.document_id = b.document_id AND t.text = trim(b.text) LEFT JOIN r ON r.document_id = b.document_id AND r.text = trim(b.text)
  WHERE pages <= 1 OR NOT (line = top AND coalesce(t.n, 0) >= greatest(2, floor(pages * 0.3)) OR line = bottom AND coalesce(r.n, 0) >= greatest(2, floor(pages * 0.3)))),
{Q._MENTIONS.format("kept")}
SELECT * EXCLUDE (wrong), CASE WHEN wrong THEN 'flagged' ELSE 'verified' END AS stage, NOT wrong AS verified, CASE WHEN wrong THEN 'HEADING_NUMBER' END AS fail_reason FROM (SELECT *, contains(quote, 'Section') AS wrong FROM mentions)"""
)
def money_facts(spark, sf_dir):
    return W.money_facts(Q._money_lines(spark, sf_dir)).drop("currency")


_SIGN = "(({0} + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_CODES = "list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)"


@query(
    f"""WITH t AS (SELECT doc_id, {D._TOKENS} AS ws FROM documents), w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM t) GROUP BY 1, 2),
c AS (SELECT count(*) AS n FROM documents), i AS (SELECT w, ln((max(c.n) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM w, c GROUP BY w),
k AS (SELECT w, idf, list_reduce(list_prepend(5381::BIGINT, {_CODES.format("w")}), lambda h, x: {_SIGN.format("(h * 32)")} + h + x) AS h FROM i),
g AS (SELECT w, unnest(list_transform(range(1, length(w) - 1), lambda j: substr(w, j, 3))) AS g FROM i WHERE length(w) >= 4),
e AS (SELECT w, h, 1.0::DOUBLE AS s FROM k UNION ALL SELECT w, list_reduce(list_prepend(2166136261::BIGINT, {_CODES.format("g")}), lambda h, x: {_SIGN.format("(xor((h + 4294967296) % 4294967296, x) * 16777619)")}), 0.4 FROM g),
r AS (SELECT doc_id, abs(h) % 768 AS bucket, sum((1 + ln(n)) * idf * s * CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS x FROM w JOIN i USING (w) JOIN e USING (w) GROUP BY 1, 2)
SELECT doc_id, bucket::INT AS bucket, round(1e6 * x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::BIGINT AS millionths FROM r QUALIFY millionths <> 0"""
)
def tfidf_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = W.tfidf_embedding(docs, S.corpus_idf(docs, "doc_id"), "doc_id")
    return entries.select("doc_id", "bucket", F.round(F.col("weight") * 1e6).cast("long").alias("millionths"))


@query(
    D._CHAIN.replace("WHEN k = 4 AND", "WHEN FALSE AND").replace("WHEN k IN (4, 8) AND", "WHEN FALSE AND")
    + r""", l AS (SELECT list_filter(list_transform(string_split(page_text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20) AS c FROM p WHERE trim(coalesce(page_text, ''), ' ') <> ''),
e AS (SELECT trim(coalesce(page_text, ''), ' ') <> '' AS ok FROM p)
SELECT 'pages' AS part, count(*) FILTER (ok)::BIGINT AS n FROM e UNION ALL SELECT 'events', sum(CASE WHEN ok THEN 10 ELSE 2 END)::BIGINT FROM e
UNION ALL SELECT 'chunks', sum(greatest(1, len(c)))::BIGINT FROM l UNION ALL SELECT 'facts', count(*)::BIGINT FROM v UNION ALL SELECT 'published', count(*) FILTER (fail_reason IS NULL)::BIGINT FROM v"""
)
def ingest_counts(spark, sf_dir):
    facts, pages = D._proposals(spark, sf_dir)
    return _counts(W.ingest(pages, facts))


@query(
    D._CHAIN + """, d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'geo' ELSE 'image' END AS kind, doc_id % 9 <> 0 AND trim(coalesce(page_text, ''), ' ') <> '' AS ok FROM p),
s AS (SELECT * FROM (VALUES (1, 'validating'), (2, 'extracting'), (3, 'chunking'), (4, 'embedding'), (5, 'classification'), (6, 'fact_extraction'), (7, 'verification'), (8, 'synthesis'), (9, 'building_visuals'), (10, 'done')) s(n, stage)),
e AS (SELECT doc_id, n, stage, n * 10 AS progress FROM d, s WHERE ok AND NOT (kind IN ('csv', 'geo') AND n = 6) UNION ALL SELECT doc_id, 1, 'validating', 10 FROM d WHERE NOT ok UNION ALL SELECT doc_id, 2, 'failed', 0 FROM d WHERE NOT ok)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS sequence, stage, progress::INT AS progress, CASE stage WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'processing' END AS status FROM e"""
)
def ingest_events(spark, sf_dir):
    facts, pages = D._proposals(spark, sf_dir)
    k = F.col("document_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "csv", "geo", "image")]), (k % 4 + 1).cast("int"))
    pages = pages.withColumns({"kind": kind, "text": F.when(k % 9 != 0, F.col("text"))})
    return W.ingest(pages, facts)["events"]
