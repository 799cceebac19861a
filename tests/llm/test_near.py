import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import minhash as mh
from factloom.llm import nn_descent as nn
from factloom.llm.common import components
from factloom.llm.nn_descent import audit, near_vectors
from factloom.llm.shingles import shingle_sets

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets_have_the_right_sizes(k):
    texts = ["", "  ", "a", "a b", "A b\x0bC a b c", "ä Ä x\x1cy", "w " * 3000, "no break here it is"]
    for t, got in zip(texts, shingle_sets(pa.array(texts), k), strict=True):
        assert len(got) == len(sets_of(t, k)) and (np.diff(got.astype(float)) >= 0).all()
    assert list(shingle_sets(pa.array(["A b c"]), 3))[0].tolist() == list(shingle_sets(pa.array(["x", "a\tb  c"]).slice(1), 3))[0].tolist()


def test_words_made_to_collide_do_not(spark):
    pair = ["abcdefghijklmnop", "iynu}'{wg&j;jv8)"]
    a, b = shingle_sets(pa.array(pair), 1)
    assert a.tolist() != b.tolist()
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert all(r["kept"] for r in mh.near_duplicates(docs).collect())


def test_bands_miss_few():
    for percent in (80, 85, 90):
        bands, rows = mh.bands_for(percent)
        assert bands * rows <= mh.COORDINATES and (1 - (percent / 100) ** rows) ** bands < 1e-6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3200], rng.integers(0, 1 << 63, 800).astype(np.uint64)])
    c = mh.circulant()
    assert abs((c.signature(a) == c.signature(b)).mean() - 2 / 3) < 0.15


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)) for _ in range(20)]
    want = [[len(set(x) & set(y)) for y in sets[7:]] for x in sets[:7]]
    assert mh.intersections(sets[:7], sets[7:]).tolist() == want


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(30)]
    base = [word() for _ in range(120)]
    for i in range(40):  # one chain of copies, each a little further from the last
        base[rng.randrange(120)] = word()
        rows.append((100 + i, " ".join(base)))
    rows += [(300 + i, rows[0][1]) for i in range(5)] + [(400, None), (401, ""), (402, "one"), (403, "ONE"), (404, "one two"), (405, "w " * 4000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows] + [(None, rows[1][1], "x"), (400, None, "again")], "doc_id long, text string, component_id string")
    s = {i: sets_of(t, 3) for i, t in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = roots(s, links)
    got = mh.near_duplicates(df, k=3, percent=85).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert mh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    nodes = sorted({x for e in edges for x in e} | {999})
    got = components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == roots(nodes, edges)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"), rounds=1)


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[0] + rng.normal(size=(60, 16)) * 0.02  # a cluster larger than the lists
    x[270] = x[10] + 0.01
    x[271] = x[11]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0], 1), (905, [], 1), (None, rows[0][1], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(range(300), [(int(a), int(b)) for a, b in np.argwhere(near)])
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), k=6)
    for r in got.collect():
        if r.vec_id is None or r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == (int(near[r.vec_id].sum()), want[r.vec_id])
    nodes = spark.createDataFrame([(i, u[i].tobytes(), 1) for i in range(300)], "id long, unit binary, copies long")
    full = spark.createDataFrame([(i, int(near[i].sum())) for i in range(300)], "id long, n_links long")
    assert audit(nodes, full, 0.9, 300) == 1.0
    assert audit(nodes, full.selectExpr("id", "n_links div 2 as n_links"), 0.9, 300) < 0.6


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_near_vectors_link_tight_subgroups(spark):
    rng = np.random.default_rng(9)
    main = np.eye(16)[0]
    centers = [main + 0.35 * np.eye(16)[i] for i in (1, 2, 3)]  # any two of them at a cosine of about 0.89: only some members link
    x = np.concatenate([c + rng.normal(size=(110, 16)) * 0.02 for c in centers] + [rng.normal(size=(60, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[:110].sum(axis=1).min() > 100 and near[:110, 110:220].any()
    want = roots(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near)])
    got = near_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert [(r.n_links, r.component_id) for r in sorted(got)] == [(int(near[i].sum()), want[i]) for i in range(len(x))]


def test_near_vectors_end_exactly_when_the_audit_fails(spark, monkeypatch):
    efforts = []

    def nothing(vectors, k, rounds, tables=nn.TABLES, window=nn.SORT_BLOCK):
        efforts.append((k, rounds, tables, window))
        return spark.createDataFrame([], "id long, near array<struct<sim float, other long>>")

    monkeypatch.setattr(nn, "descend", nothing)
    monkeypatch.setattr(nn, "EXACT_BLOCK", 16, raising=False)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 16)), 2, axis=0) + rng.normal(size=(60, 16)) * 0.02
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(range(60), [(int(a), int(b)) for a, b in np.argwhere(near)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = near_vectors(spark.createDataFrame([*rows, (99, rows[0][1]), (100, [1.0])], "vec_id long, embedding array<double>")).collect()
    copies = near[:, 0] * 1
    copies[0] = 1
    want = [(i, int(near[i].sum() + copies[i]), want[i]) for i in range(60)] + [(99, int(near[0].sum() + 1), want[0]), (100, 0, 100)]
    assert [(r.vec_id, r.n_links, r.component_id) for r in sorted(got)] == want
    assert len(efforts) > 1 and all(a < b for a, b in zip(efforts[0], efforts[-1], strict=True))


def test_audit_counts_each_vector_alike(spark):
    u = np.eye(70)[[*([0] * 40), *np.repeat(np.arange(1, 21), 2)]]  # one group of 40, twenty pairs
    nodes = spark.createDataFrame([(i, r.tobytes(), 1000 if i < 40 else 1) for i, r in enumerate(u)], "id long, unit binary, copies long")
    lost = spark.createDataFrame([(i, 39 if i < 40 else 0) for i in range(80)], "id long, n_links long")
    assert audit(nodes, lost, 0.9) == 0.5


def test_repeated_ids_with_other_vectors_keep_their_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (1, [1.0, 0.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_a_pair_within_rounding_is_judged_one_way():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = (x[3] * x[7]).sum()
    for t in (exact, np.nextafter(exact, 1), np.nextafter(exact, -1)):
        for a, b in ((x, x), (x[:9], x[5:8])):
            near = nn._judged(a @ b.T, a, b, t)
            assert near[3, 7 if len(b) > 7 else 2] == (exact >= t)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_with_the_same_polynomial_hash_differ(spark):
    bits = thue_morse(1024)
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    got = mh.near_duplicates(spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string"), k=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_large_intersections_are_counted_in_whole_numbers():
    shared = np.arange(700_000)
    got = mh.intersections([shared], [np.concatenate([shared, [-1]])])
    assert got.tolist() == [[700_000]] and (100 * got.astype(np.int64)).tolist() == [[70_000_000]]


def test_audit_meets_rare_partners(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 32))
    x[3000:3100] = x[:100] + 0.1 * rng.normal(size=(100, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, unit binary")
    report = {}
    assert audit(nodes, nodes.selectExpr("id", "0L AS n_links"), 0.9, report=report) < 0.05
    assert report["with_partners"] >= 100
    truth = nodes.selectExpr("id", "CASE WHEN id < 100 OR id BETWEEN 3000 AND 3099 THEN 1L ELSE 0L END AS n_links")
    assert audit(nodes, truth, 0.9, report=report) == 1.0 and report["looked_at"] > 0


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}
