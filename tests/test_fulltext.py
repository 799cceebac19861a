import random
import re
import shutil
import zlib

import pyarrow as pa
import pytest
from test_stemming import plain_stem

from factloom.functions.stemming import STOP_WORDS
from factloom.operators import fulltext as T

POOL = "run running runs budget budgets budgeting the of and road roads 42 ke na 1 x allocation allocated zürich élan".split()


def placed(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [(i + 1, plain_stem(w)) for i, w in enumerate(words) if w not in STOP_WORDS]


def plain_rank(text, query):
    """The rank of a text, or None where it does not match: covers are found by trying every stretch."""
    words = re.findall(r"[^\W_]+", query.lower())
    keywords = {w for w in words if len(w) > 2 and re.fullmatch("[a-z]+", w)}
    some, every = ({plain_stem(w) for w in ws if w not in STOP_WORDS} for ws in (keywords, words))
    held = placed(text)
    stems = {s for _, s in held}
    if not (some & stems or (every and every <= stems)):
        return None
    if keywords:
        return 0.1 * sum(s in some for _, s in held)
    hits = [(p, s) for p, s in held if s in every]
    whole = [(a, b) for a in range(len(hits)) for b in range(a, len(hits)) if {s for _, s in hits[a : b + 1]} == every]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + hits[b][0] - hits[a][0] - (b - a)) for a, b in least)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(POOL) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "Running, RUNS; run!"), (203, "na-ke/1"), (204, "ke " * 300 + "na 1")]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "text")
    T.write_index(spark.createDataFrame(texts, "doc_id long, text string"), path, "doc_id", parts=16, block=20)
    return path


QUERIES = ["The running budgets of Zürich", "ke na 1", "na", "1 42", "of the", "the 42", "allocations", "nothing here", "", "roads & 42", "élan", "ke ke na ke"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_match_brute_force(spark, texts, index, query):
    want = sorted((i, round(r, 9)) for i, t in texts if (r := plain_rank(t, query)) is not None)
    rows = lambda df: sorted((r["doc_id"], round(r["rank"], 9)) for r in df.collect())
    assert rows(T.search(spark.createDataFrame(texts, "doc_id long, text string"), query, "doc_id")) == want
    assert rows(T.search_index(spark, index, query)) == want
    few = spark.createDataFrame([(i,) for i in range(0, 205, 7)], "doc_id long")
    assert rows(T.search_index(spark, index, query, few)) == [x for x in want if x[0] % 7 == 0]


def test_an_index_search_reads_its_words_folders_only(spark, texts, index, tmp_path):
    terms = T.query_terms(spark, "budgeting roads")
    plan = T.index_hits(spark, index, terms)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*part#\d+L? (IN|INSET|=)", plan) and "In(stem" in plan
    copy = tmp_path / "copy"
    shutil.copytree(index, copy)
    parts = {f"part={zlib.crc32(t.encode()) % 16}" for t in terms.every}
    spoiled = [f for f in copy.glob("postings/part=*/*") if f.parent.name not in parts]
    for f in spoiled:
        f.write_bytes(b"not read")
    assert spoiled and sorted(map(str, T.index_hits(spark, str(copy), terms).collect())) == sorted(map(str, T.index_hits(spark, index, terms).collect()))


def test_no_posting_row_grows_with_the_texts(spark, index):
    rows = spark.read.parquet(f"{index}/postings").selectExpr("stem", "size(postings) AS n", "postings.key AS keys").collect()
    assert max(r["n"] for r in rows) < 90 and len([r for r in rows if r["stem"] == "run"]) > 1  # two spellings of 20 texts or so
    assert all(r["keys"] == sorted(r["keys"]) for r in rows)


def test_many_queries_match_single_ones(spark, index):
    asked = [(i, q) for i, q in enumerate(QUERIES)]
    got = {(r["query_id"], r["place"]): (r["doc_id"], round(r["rank"], 9)) for r in T.search_many(spark, index, spark.createDataFrame(asked, "query_id long, text string"), top=5).collect()}
    for i, q in asked:
        terms = T.query_terms(spark, q)
        best = T.best(T.search_index(spark, index, q), "doc_id", 5).collect() if terms.some else []
        assert [got.get((i, k + 1)) for k in range(len(best))] == [(r["doc_id"], round(r["rank"], 9)) for r in best]
    assert len(T.search_many(spark, index, spark.createDataFrame([], "query_id long, text string")).collect()) == 0


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    T.write_index(none, str(tmp_path / "i"), "doc_id")
    assert T.search(none, "budget", "doc_id").count() == 0


def test_pairs_of_queries_and_texts_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, "alpha beta " * (i % 3 + 1)) for i in range(40)], "id long, text string")
    T.write_index(df, str(tmp_path / "i"), "id", block=8)
    got = T.search_many(spark, str(tmp_path / "i"), spark.createDataFrame([(q, "alpha beta") for q in range(30)], "query_id long, text string"), top=2)
    assert "hashpartitioning(query_id#" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "id#" in x.split("query_id#", 1)[-1])
    assert sorted((r.query_id, r.id, round(r["rank"], 6), r.place) for r in got.collect()) == sorted((q, i, 0.6, p) for q in range(30) for p, i in ((1, 2), (2, 5)))


def test_occurrences_are_grouped_where_texts_are_read(spark):
    df = spark.createDataFrame([(1, "Run ran run"), (1, "run"), (2, None)], "id long, text string")
    found = T.occurrences(df, "id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.word, list(r.positions)) for r in found.collect()) == [(1, "ran", [2]), (1, "run", [1]), (1, "run", [1, 3])]


def test_words_of_long_and_empty_texts_are_grouped_over_batches():
    texts = [(1, ["b", "a", "b"]), (2, []), (3, ["é"] * 5), (4, ["a", "c"])]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([w for _, w in texts], pa.list_(pa.string()))], names=["key", "words"])
    for part in (batch, batch.slice(1)):
        got = [tuple(r.values()) for most in (2, 1 << 20) for b in T._grouped([part], most) for r in b.to_pylist()]
        want = [(k, w, [i + 1 for i, x in enumerate(ws) if x == w]) for k, ws in texts[batch.num_rows - part.num_rows :] for w in set(ws)]
        assert sorted(got) == sorted(want * 2)
