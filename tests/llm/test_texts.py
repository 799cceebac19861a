import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import mixing as mx
from factloom.llm import sentencepiece_scan as sp
from factloom.llm import suffix_dedup as sd
from factloom.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
ODD = ["", "a", " ", "  a  b ", "\n\nfoo\n bar", "漢字 ñ é 😀!", "a" * 32, "x" * 300, "the quick brown fox " * 12]


def removed(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        cover = np.zeros(len(r) + 1, dtype=int)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_repeats_match_brute_force(spark, crowd):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passage = noise(90)
    rows = [(i, noise(rng.randrange(200)) + passage[rng.randrange(30) :] + noise(30)) for i in range(12)]
    rows += [(20, noise(150)), (21, None), (22, ""), (23, "ab" * 200), (24, "q" * 500), (25, passage), (26, noise(39))]
    rows += [(30, rows[12][1]), (31, rows[12][1][:100]), (20, rows[12][1]), (None, passage), (40, noise(70_000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int")
    got = sd.remove_repeats(df, length=40, gram=16, crowd=crowd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed(rows, 40)
    for r in got:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_strings_with_the_same_polynomial_hash_stay(spark, crowd):
    bits = [bin(i).count("1") % 2 for i in range(256)]
    one, two = "".join("!F"[b] for b in bits), "".join("F!"[b] for b in bits)
    rows = [(1, one), (2, two), (3, one[:100])]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=256, gram=8, crowd=crowd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed(rows, 256) and not any(r.n_removed for r in got)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_repeats_behind_a_full_filter(spark, monkeypatch, crowd):
    assert sd._filter_bits(10**12) <= 1 << 27  # what driver and workers hold stays the same at any size
    monkeypatch.setattr(sd, "MOST_BITS", 64)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passage = noise(80)
    rows = [(i, noise(rng.randrange(300)) + passage[rng.randrange(30) :] + noise(30)) for i in range(8)]
    rows += [(8, rows[2][1]), (8, rows[2][1]), (9, None), (None, "ab" * 90)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=16, crowd=crowd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed(rows, 40)


def test_repeats_of_nothing(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deep_shallow_sorts_and_groups():
    rng = np.random.default_rng(1)
    for _ in range(10):
        blob = rng.integers(97, 99, 2000).astype(np.uint8)
        blob[1000:1500] = blob[:500]
        starts = np.sort(rng.choice(1950, 900, replace=False))
        got = {i for g in sd.deep_shallow(blob, starts, 44) for i in g}
        count = Counter(blob[s : s + 44].tobytes() for s in starts)
        assert got == {i for i, s in enumerate(starts) if count[blob[s : s + 44].tobytes()] > 1}


def test_blind_trie_orders_strings():
    words = [bytes(random.Random(i).choice(b"ab") for i in range(k, k + 9)) for k in range(60)] + [b"aaaaaaaaa"] * 3
    trie = sd.BlindTrie(lambda i: words[i])
    for i in range(len(words)):
        trie.insert(i)
    leaves = list(trie.leaves())
    assert [words[g[0]] for g in leaves] == sorted(set(words)) and all(len({words[i] for i in g}) == 1 for g in leaves)


def brute_pieces(v, text):
    t = sp.prepared(text)
    ids = {v.pieces[i]: i for i in range(len(v.pieces)) if i > 2 and i not in v.byte_of and v.scores[i] > sp.FLOOR}
    best = [(0, 0, 0)] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for k in range(min(v.longest, e), 0, -1):
            i = ids.get(t[e - k : e], v.unknown if k == 1 else None)
            if i is not None and (best[e] is None or best[e - k][0] + v.scores[i] > best[e][0]):
                best[e] = (best[e - k][0] + v.scores[i], e - k, i)
    path, e = [], len(t)
    while e:
        path.append((best[e][1], best[e][2]))
        e = best[e][1]
    starts, pieces = (np.array(x, dtype=int) for x in (zip(*path[::-1], strict=True) if path else ((), ())))
    return v.spelled((starts, pieces), t)


def test_words_equal_one_pass_and_the_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    v = sp.vocabulary_of(MODEL)
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.score <= sp.FLOOR:
            p.type = 5
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text, got in zip(ODD, v.encode(ODD), strict=True):
        assert got == brute_pieces(v, text)
        assert v.decode(np.frombuffer(got, v.dtype)) == text
        if "\n" not in text and "漢" not in text:
            assert np.frombuffer(got, v.dtype).tolist() == library.encode(text)


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 0, (7, 4, 4))
    for n in range(1, 8):
        one = m[:1]
        for i in range(1, n):
            one = sp.product(one, m[i : i + 1])
        assert (sp.total(m[:n]) == one[0]).all()
        first = np.full(4, sp.NONE)
        first[0] = 0
        assert (sp.product(sp.entries_of(first, m[:n])[-1][None, None, :], m[n - 1 : n])[0, 0] == one[0][0]).all()


@pytest.mark.parametrize("giant, chunk", [(20, 7), (50, 64)])
def test_chunks_equal_one_pass(spark, monkeypatch, giant, chunk):
    monkeypatch.setattr(sp, "FAN", 3 if chunk == 7 else 64)
    v = sp.vocabulary_of(MODEL)
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "thermodynamics" * 20 + "\n" + "ab " * 40])]
    got = sp.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL, giant_chars=giant, chunk_chars=chunk).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == dict(zip([r[0] for r in rows], v.encode([t or "" for _, t, _ in rows]), strict=True))


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    rows += rows[:3] + [(None, "null id"), (99, "a \u2581 b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    for giant in (1 << 16, 10):
        got = sp.encode_and_check(df, MODEL, keep_ids=True, giant_chars=giant, chunk_chars=16).collect()
        assert len(got) == len(rows) and all(r.round_trip == (r.doc_id != 99) for r in got)
        by_id = {r.doc_id: r for r in got}
        v = sp.vocabulary_of(MODEL)
        for (i, t), ids in zip(rows, v.encode([t or "" for _, t in rows]), strict=True):
            assert (bytes(by_id[i].ids), by_id[i].n_ids) == (ids, len(ids) // 2)
            assert by_id[i].ids_crc32 == zlib.crc32(np.frombuffer(ids, v.dtype).astype("<u4").tobytes())
    assert sp.encode_and_check(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def _docs(spark, n=400):
    sources = ["a"] * 6 + ["b", "c", None]
    rows = [(i, "word " * (5 + i % 50), sources[i % 9], ["en", "de", None][i % 3 if i % 4 else 0], "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")


def test_mix_meets_targets(spark):
    target = {"source": {"a": 0.25, "b": 0.25, "c": 0.25}, "lang": {"en": 0.5, "de": 0.25}}
    got = mx.mix(_docs(spark), target, budget=0.2).toPandas()
    got["t"] = got.n_tokens * got.probability
    total = got.t.sum()
    assert total == pytest.approx(0.2 * got.n_tokens.sum(), rel=0.02)
    for col, want in target.items():
        for value, share in want.items():
            assert got[got[col] == value].t.sum() / total == pytest.approx(share, abs=0.02)
    assert got.probability.between(0, 1).all() and abs(got.selected.mean() - got.probability.mean()) < 0.1


def test_mix_is_native_and_repeatable(spark):
    one, two = (mx.mix(_docs(spark)) for _ in range(2))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_draw_takes_what_mix_marks(spark):
    docs = _docs(spark)
    drawn = mx.draw(docs)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in mx.mix(docs).filter("selected").collect())
    assert not any(w in drawn._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, "", "a", "en"), (2, "x " * 40_000, "a", "en"), (2, "x " * 40_000, "a", "en")], "doc_id long, text string, source string, lang string")
    got = mx.mix(df).collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1 for r in got)
    assert mx.mix(df.limit(0)).collect() == [] and mx.draw(df.limit(0)).collect() == []
