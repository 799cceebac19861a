"""Driver queries of full-text search and the DuckDB SQL that stems, places and ranks in its own terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import stemming as E
from factloom.operators import fulltext as T
from factloom.session import fresh_dir, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SHORT = r"regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
_DOUBLE = "regexp_matches({0}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')"
_REGION = "coalesce(nullif(length(regexp_extract({0}, '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length({0}))"
_END = "length(w) - length(s)"

#: Subqueries from `vocabulary (word)` to `stems (word, stem)`.
STEMS_SQL = f"""s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM vocabulary),
s1 AS (SELECT *, CASE WHEN w LIKE 'gener%' OR w LIKE 'arsen%' THEN 5 WHEN w LIKE 'commun%' THEN 6 ELSE {_REGION.format("w")} END AS p1 FROM s0),
s2 AS (SELECT *, p1 + {_REGION.format("substr(w, p1 + 1)")} AS p2 FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
  WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w) FROM s2),
s4 AS (SELECT *, w IN ({_listed(E.KEPT_AFTER_PLURALS)}) AS whole, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS s, regexp_replace(w, '(eedly|ingly|edly|eed|ing|ed)$', '') AS b FROM s3),
s5 AS (SELECT word, p1, p2, whole, CASE WHEN whole OR s = '' THEN w WHEN s LIKE 'eed%' THEN CASE WHEN length(b) >= p1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN {_DOUBLE.format("b")} THEN b[:-2] WHEN {_SHORT.format("b")} AND length(b) = p1 THEN b || 'e' ELSE b END AS w FROM s4),
s6 AS (SELECT * REPLACE (CASE WHEN whole THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w) FROM s5),
s7 AS (SELECT *, regexp_extract(w, '({"|".join(E.SECOND)})$', 1) AS s FROM s6),
s8 AS (SELECT * EXCLUDE (s) REPLACE (CASE WHEN NOT whole AND s <> '' AND {_END} >= p1 AND (s <> 'ogi' OR w LIKE '%logi') AND (s <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$')) THEN left(w, {_END}) || {_case(E.SECOND, "s")} ELSE w END AS w) FROM s7),
s9 AS (SELECT *, regexp_extract(w, '({"|".join(E.THIRD)})$', 1) AS s FROM s8),
s10 AS (SELECT * EXCLUDE (s) REPLACE (CASE WHEN NOT whole AND s <> '' AND {_END} >= CASE s WHEN 'ative' THEN p2 ELSE p1 END THEN left(w, {_END}) || {_case(E.THIRD, "s")} ELSE w END AS w) FROM s9),
s11 AS (SELECT *, regexp_extract(w, '({"|".join(E.FOURTH)})$', 1) AS s FROM s10),
s12 AS (SELECT * EXCLUDE (s) REPLACE (CASE WHEN NOT whole AND s <> '' AND {_END} >= p2 AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN left(w, {_END}) ELSE w END AS w) FROM s11),
s13 AS (SELECT * REPLACE (CASE WHEN NOT whole AND (w LIKE '%e' AND (length(w) > p2 OR length(w) > p1 AND NOT {_SHORT.format("w[:-2]")}) OR w LIKE '%ll' AND length(w) > p2) THEN w[:-2] ELSE w END AS w) FROM s12),
stems AS (SELECT word, CASE WHEN length(word) <= 2 OR NOT regexp_full_match(word, '\\p{{L}}+') THEN word WHEN word IN ({_listed(E.EXCEPTIONS)}) THEN {_case(E.EXCEPTIONS, "word")} ELSE replace(w, 'Y', 'y') END AS stem FROM s13)"""

_PLACED = r"""placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents))"""
_BASE = f"""WITH {_PLACED},
vocabulary AS (SELECT DISTINCT word FROM placed WHERE word NOT IN ({_listed(E.STOP_WORDS)})),
{STEMS_SQL},
hits AS (SELECT doc_id, pos, stem FROM placed JOIN stems USING (word))
"""

#: Any-matching: words of two letters, stop words and numbers do not count.
ANY = "The running of connected generations and of 42 by general consideration"
_ANY_STEMS = ("run", "connect", "generat", "general", "consider")
#: All-matching: no word of three letters or more, so all its words must be there.
ALL = "na to ke me 1 a"
#: Texts whose words answer ALL: the operator's own rule of matching, over the words that occur in the table.
_TEXTS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' na running ke 1 generations considered na 1' WHEN doc_id % 5 = 1 THEN 'ke na 1 x na generally ke ' || text WHEN doc_id % 5 = 2 THEN 'connecting 1 ke' ELSE text END AS text FROM documents"""


def _docs(spark, sf_dir):
    """The documents with planted words, so that every branch of matching occurs beside the words they have."""
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.concat("text", F.lit(" na running ke 1 generations considered na 1"))).when(k == 1, F.concat(F.lit("ke na 1 x na generally ke "), "text")).when(k == 2, "connecting 1 ke").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_PLANTED = _BASE.replace("FROM documents))", f"FROM ({_TEXTS})))")
_RANK_ANY = f"SELECT doc_id, round(count(*) * 0.1::DOUBLE, 6) AS rank FROM hits WHERE stem IN ({_listed(_ANY_STEMS)}) GROUP BY doc_id"
_RANK_ALL = """, k AS (SELECT doc_id, pos, row_number() OVER w AS i, last_value(CASE stem WHEN 'na' THEN pos END IGNORE NULLS) OVER w AS a, last_value(CASE stem WHEN 'ke' THEN pos END IGNORE NULLS) OVER w AS b, last_value(CASE stem WHEN '1' THEN pos END IGNORE NULLS) OVER w AS c
  FROM hits WHERE stem IN ('na', 'ke', '1') WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT doc_id, pos, i, least(a, b, c) AS start FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
g AS (SELECT f.doc_id, f.pos, f.i, start, lag(start) OVER (PARTITION BY f.doc_id ORDER BY f.i) AS before, k.i AS first FROM f JOIN k ON k.doc_id = f.doc_id AND k.pos = f.start)
SELECT doc_id, round(sum(CASE WHEN before IS NULL OR start > before THEN 0.1::DOUBLE / (1 + (pos - start) - (i - first)) ELSE 0 END), 6) AS rank FROM g GROUP BY doc_id"""


@query(_BASE.split("hits AS")[0].rstrip().rstrip(",") + " SELECT word, stem FROM stems")
def stem_vocabulary(spark, sf_dir):
    found = T.occurrences(table(spark, sf_dir, "documents"), "doc_id")
    return E.with_stems(found.select("word").distinct()).select("word", "stem")


@query(_PLANTED + _RANK_ANY)
def fulltext_any(spark, sf_dir):
    return T.search(_docs(spark, sf_dir), ANY, "doc_id").withColumn("rank", F.round("rank", 6))


@query(_PLANTED + _RANK_ALL)
def fulltext_covers(spark, sf_dir):
    return T.search(_docs(spark, sf_dir), ALL, "doc_id").withColumn("rank", F.round("rank", 6))


def _indexed(spark, sf_dir):
    path = fresh_dir(spark, "text-index")
    T.write_index(_docs(spark, sf_dir), path, "doc_id")
    return path


@query(_PLANTED + _RANK_ANY)
def fulltext_index_any(spark, sf_dir):
    return T.search_index(spark, _indexed(spark, sf_dir), ANY).withColumn("rank", F.round("rank", 6))


@query(_PLANTED + _RANK_ALL)
def fulltext_index_covers(spark, sf_dir):
    return T.search_index(spark, _indexed(spark, sf_dir), ALL).withColumn("rank", F.round("rank", 6))


_WITH_QUESTIONS = _PLANTED.replace("SELECT DISTINCT word FROM placed WHERE", r"SELECT DISTINCT word FROM (SELECT word FROM placed UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) FROM benchmark) WHERE")


@query(
    _WITH_QUESTIONS + r""", q AS (SELECT DISTINCT query_id, stem FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark) JOIN stems USING (word) WHERE regexp_full_match(word, '[a-z]{3,}')),
r AS (SELECT query_id, doc_id, count(*) AS n FROM q JOIN hits USING (stem) GROUP BY ALL)
SELECT query_id, doc_id, round(n * 0.1::DOUBLE, 6) AS rank, (row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id))::INT AS place FROM r QUALIFY place <= 8"""
)
def fulltext_many(spark, sf_dir):
    """Every benchmark passage as a query against all documents, through the index."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return T.search_many(spark, _indexed(spark, sf_dir), asked).withColumn("rank", F.round("rank", 6))
