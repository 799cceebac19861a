import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from factloom.llm.exact_dedup import LsmIndex, exact_dedup
from factloom.llm.url_filter import url_verdicts

DOCS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (5, "b", None), (5, "b", None), (None, "c", ""), (None, "a", ""), (7, "long " * 5000, ""), (8, "long " * 5000, ""), (9, "A", "")]
SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = {t: (keep([i for i in ids if i is not None]) if any(i is not None for i in ids) else None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("keep, digest_bytes", [("min", 32), ("max", 32), ("max", 0), ("min", 1)])
def test_exact_dedup_matches_brute_force(spark, keep, digest_bytes):
    rows = DOCS + [(100 + i, f"text {i % 40}", None) for i in range(120)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), keep=keep, digest_bytes=digest_bytes, memtable_rows=7, fanout=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, {"min": min, "max": max}[keep])


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_compacts_and_keeps_the_smallest():
    index = LsmIndex("min", memtable_rows=4, fanout=2)
    digests = [bytes([i % 5]) * 32 for i in range(50)] + [b"z" * 32]
    for i, d in enumerate(digests):
        index.put(pa.table({"digest": [d], "keep_id": [100 - i], "n": [1]}, schema=pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])))
    out = index.repeated().to_pylist()
    assert [(r["digest"][0], r["keep_id"], r["n"]) for r in out] == [(i, 100 - 45 - i, 10) for i in range(5)]
    assert sum(len(level) for level in index.levels) < 8


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "bad.org")]
URLS = [
    (1, "http://www.Example.com/en/1", "com/"), (2, "http://a.example.com/en/1?q#f", None), (3, "https://x.com?z", None), (4, "https://x.com/", None), (5, "http://net/es/", None),
    (6, "http://a.net/en/", None), (7, None, None), (8, "no scheme/en/", None), (9, "http://notexample.com/en/", None), (10, "ftp://BAD.org", None), (11, "http://bad.org#x", None), (12, "://", None), (2, "http://a.example.com/en/1?q#f", None),
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, a) for a, r in RULES if (h := r.partition("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bytes", [1 << 20, 8])
def test_url_verdicts(spark, max_bytes):
    df = spark.createDataFrame(URLS, "page_id long, url string, host string")
    got = url_verdicts(df, RULES, max_filter_bytes=max_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *judge(u)) for i, u, _ in URLS), key=str)


def test_url_cascade_is_exact_over_many_hosts(spark):
    rules = [("block", f"h{i}.test/p") for i in range(0, 400, 3)]
    df = spark.range(800).selectExpr("id as page_id", "concat('http://h', id % 400, '.test/p', id) as url")
    got = {r.page_id: r.verdict for r in url_verdicts(df, rules).collect()}
    assert got == {i: "block" if (i % 400) % 3 == 0 else "allow" for i in range(800)}


def test_url_plan_is_native(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, host string")
    plan = url_verdicts(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Join", "Exchange"))


def test_url_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(df, RULES).collect() == []
    assert url_verdicts(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), []).first().verdict == "allow"
