"""The queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.filter_audit import filter_audit
from factloom.llm.language_id import identify_language
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import mix
from factloom.llm.nn_descent import near_vectors
from factloom.llm.periodic_runs import periodic_runs
from factloom.llm.quality import quality_scores
from factloom.llm.sentencepiece_scan import encode_and_check
from factloom.llm.sharding import shard_documents
from factloom.llm.suffix_dedup import remove_repeats
from factloom.llm.token_ids import read_token_ids, write_token_ids
from factloom.llm.url_filter import url_verdicts
from factloom.session import table

QUERIES, ORACLES = {}, {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


#: The production rule list: (action, host and path).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op2_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op2_url_filter"] = """
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM fit"""


@query
def op3_token_ids(spark, sf_dir):
    return read_token_ids(*write_token_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@query
def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op5_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op7_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


@query
def op8_sentencepiece(spark, sf_dir):
    return encode_and_check(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op9_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def _mix_sql(docs: str = "documents", rounds: int = 24, flatten: float = 0.7, budget: float = 0.75) -> str:
    """The raking unrolled: one subquery a round and marginal."""
    steps = [
        f"""rows_ AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.|\\+[0-9]{{1,3}} \\(|(password|token|key) ?[=:]') THEN 'contact'
               WHEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 >= 4
                AND length(coalesce(text, '')) < 120 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) THEN 'listing'
               WHEN length(coalesce(text, '')) < 400 THEN 'note' ELSE 'prose' END AS topic,
          greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS n_tokens FROM {docs})""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM rows_ GROUP BY ALL)",
    ]
    for m in ("source", "lang", "topic"):
        steps.append(f"share_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {flatten}) / sum(pow(sum(tokens)::DOUBLE, {flatten})) OVER () * {budget} * (SELECT sum(tokens) FROM cells) AS want FROM cells GROUP BY {m})")
    last, i = "cells", 0
    for _ in range(rounds):
        for m in ("source", "lang", "topic"):
            i += 1
            weight = f"c.weight * s.want / sum(c.weight) OVER (PARTITION BY c.{m})"
            weight = f"least({weight}, c.tokens::DOUBLE)" if m == "topic" else weight
            steps.append(f"r{i} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), {weight} AS weight FROM {last} c JOIN share_{m} s USING ({m}))")
            last = f"r{i}"
    steps.append(f"chance AS (SELECT source, lang, topic, weight / tokens AS probability FROM {last})")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, nullif(source, '') AS source, nullif(lang, '') AS lang, topic, n_tokens, probability,
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < probability AS selected
FROM rows_ JOIN chance USING (source, lang, topic)"""


ORACLES["op10_mixing"] = _mix_sql()


def with_periodic_tails(docs):
    """The documents of the run query: of a tenth of the ids, by their checksum, the words from place a on repeat p words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    chosen = chosen.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("top", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.col3")).alias("period"),
        F.expr("1000 * top.length div -top.col3").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH marked AS (SELECT doc_id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT words.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false) AS e,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marked USING (doc_id)),
patterns AS (SELECT part, [a, b, c, d, e] AS f, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
paths AS (SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, k.i AS step, o[k.i] AS own, o[1:k.i - 1] AS past FROM orders, letters k),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT patterns.*, filter_order, step, own, f[own] AS fails, len(list_filter(past, lambda x: f[x])) > 0 AS gone FROM patterns, paths)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""


@query
def op13_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
