import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import queries as Q
from factloom.llm.filter_audit import filter_audit
from factloom.llm.periodic_runs import collapse, periodic_runs, runs_of, z_function
from factloom.llm.sharding import shard_documents, write_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(w, least=12):
    """Plain runs: for each period, the maximal stretches of words equal to those a period on; smallest period only."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and not any(s <= i and e >= j + q for s, e in found):
                found[i, j + q] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))] + [-1]
        want = [0] + [next(k for k in range(len(s)) if i + k == len(s) or s[k] != s[i + k]) for i in range(1, len(s))]
        assert z_function(s).tolist() == want


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for case in range(600):
        n, letters = rng.randrange(0, 90), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        if case % 3 == 0 and n:
            a, p = rng.randrange(n), rng.randrange(1, 20)
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else 7 for i in range(a, n)]
        if case % 5 == 0:
            w = w[:20] * 2 + w[20:40] * 3
        assert runs_of(np.array(w, dtype=np.int64), least) == every_run(w, least), w


def test_runs_of_a_giant_periodic_text_are_quick():
    words = [b"a", b"b", b"c"] * 70_000 + [b"x%d" % i for i in range(90_000)] + [b"z"] * 1000
    runs, kept = collapse(words)
    assert runs == [(0, 210_000, 3), (300_000, 1000, 1)] and len(kept) == 3 + 90_000 + 1


ODD = [
    (1, "a b c " * 30, "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "x\x0by\x0cz " * 9, "en"), (6, "  one two " * 12, "fr"),
    (7, "w " * 11, "en"), (8, "w " * 12, "en"), (8, "w " * 12, "en"), (None, "q r " * 40, None), (None, "A$ " * 300, "en"), (9, "a b c " * 30, "de"), (10, "a b c " * 30, "en"), (0, "", "en"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'x' AS runs", "2 AS shard", "'d' AS digest", "'m' AS mask", "3 AS size", "4 AS text_key")


def test_periodic_runs_of_odd_rows(spark):
    got = sorted((str(r[0]), r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic_runs(odd(spark)).collect())
    want = []
    for i, t, _ in ODD:
        w = WORD.findall(t or "")
        runs = every_run(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert periodic_runs(odd(spark).limit(0)).count() == 0


def test_run_query_matches_the_contract(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 150)))) for i in range(300)] + [(400, None), (401, ""), (None, "a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in rows:
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], planted + 1
        runs, r = every_run(w), got[i]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(top or (None,) * 3))
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 15 and len(got) == len(rows)


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    judged = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        judged.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, removed = [], {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                alive = [j for j in mine if not set(j[1]) & set(order[:k])]
                hit = [j for j in alive if f in j[1]]
                removed[part, f] = removed.get((part, f), 0) + len(hit)
                out.append([part, order, k + 1, len(alive) - len(hit), len(hit), sum(f in j[1] for j in mine) - len(hit), sum(j[1] == f for j in mine), sum(j[2] for j in hit), sum(j[3] for j in hit)])
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_matches_brute_force(spark):
    rng = random.Random(2)
    rows = list(ODD) + [(i, rng.choice(["", "B", "# "]) + " ".join(str(rng.randrange(rng.choice([9, 900]))) for _ in range(rng.randrange(150, 260))), rng.choice(["en", "de", None])) for i in range(20, 80)]
    rows += [(i + 100, rows[20 + i % 9][1], rng.choice(["en", "de"])) for i in range(30)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130)] + [(25, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS id")
    got = sorted(tuple(r) for r in filter_audit(odd(spark, rows), labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    want = plain_audit(rows, marks)
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit(odd(spark).limit(0), labels).count() == 0
    assert filter_audit(odd(spark), labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_filter_audit_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLES["op12_filter_audit"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in Q.op12_filter_audit(spark, sf).select(*names).collect()) == sorted(want.fetchall())


def check_shards(rows, got, shards, slack):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    held = {k: [r for r in got if r["shard"] == k] for k in range(shards)}
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in held.values()) and sum(map(len, held.values())) == len(got)
    assert {r["law"] for r in got} <= {"bytes"} and {r["grown_shard"] for r in got} <= {None}
    total, sizes = sum(r["size"] for r in got), [sum(r["size"] for r in held[k]) for k in range(shards)]
    biggest = max((r["size"] for r in got), default=0)
    assert all(abs(s - total / shards) <= max(biggest, 2 * slack * total / shards) + 1 for s in sizes), sizes


@pytest.mark.parametrize("cell_rows", [20, 1 << 16])
def test_shards_are_even_with_a_hot_text(spark, cell_rows):
    rng = random.Random(1)
    rows = [(i, "same text again" if i % 3 == 0 else "word " * rng.randrange(1, 90)) for i in range(3000)] + [(-5, None), (9999, "long " * 300), (-6, "ü" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS id", "3 AS size", "4 AS text_key", "5 AS cell")
    got = shard_documents(docs, 24, cell_rows=cell_rows).collect()
    check_shards(rows, got, 24, 0.005)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same text again")}) > 1
    again = shard_documents(docs.repartition(7), 24, cell_rows=cell_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i % 2000} of a group " * 5) for i in range(6000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, tolerance=0.02).collect()
    check_shards(rows, got, 8, 0.02)
    assert all(len({r["shard"] for r in got if r["doc_id"] % 2000 == k}) == 1 for k in range(0, 2000, 37))


@pytest.mark.parametrize("rows", [[], [(1, "x")], [(None, None), (None, "a"), (2, "a"), (2, "a")], [(1, "same")] * 50, [(i, "same") for i in range(100)]])
def test_shards_of_odd_tables(spark, rows):
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    assert len(got) == len(rows)
    if len(set(rows)) == len(rows):
        check_shards(rows, got, 24, 0.005)
    else:
        held = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(24)}
        assert all(v == list(range(len(v))) for v in held.values())


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = odd(spark, [(i, f"text {i} " * (i % 50), "en") for i in range(500)])
    write_shards(docs, str(tmp_path / "out"), 6, cell_rows=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    want = {r["doc_id"]: r["shard"] for r in shard_documents(docs, 6, cell_rows=40).collect()}
    assert {r["doc_id"]: r["shard_no"] for r in back.collect()} == want
