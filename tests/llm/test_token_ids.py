import zlib

import numpy as np
import pytest

from factloom.llm import token_ids as ti
from factloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["", "Hello, World's test.", "ÀÉ ǅ ñ İstanbul ΣΑΣ ß", "áb <|endoftext|> x<|startoftext|>y", "it's 12ab. foo_bar a\tb\x1cc d '' 漢字, é,", "..., ,. a.. b,, don'T I'LL", "end!!! x$$$ a.%% _b_ c_ d<| e|> f~`{} g@h i-j k's, l'. m\u00b7 n\u00a0o", " " * 5, "word " * 9000]


def test_memo_gives_the_library_s_ids():
    enc = ti.WordMemoEncoder(PATH)
    for text, got in zip(TEXTS, enc.encode(TEXTS), strict=True):
        assert got.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(ti, "MEMO_CORES", 2)
    enc = ti.WordMemoEncoder(PATH)
    texts = ["one two three four five six", "four five six seven"]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.cores) <= 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 5000])
def test_perfect_hash_is_minimal(n):
    ids = np.sort(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    index = ti.ShardIndex.build(ids, np.arange(1, n + 1), np.dtype("<u2"))
    index = ti.ShardIndex.from_bytes(index.to_bytes())
    assert sorted(index.phf.slots(ti._keys(index.ids, index.ordinals)).tolist()) == list(range(n))
    found, offsets, lengths = index.locate(index.ids, index.ordinals)
    assert found.all() and lengths.tolist() == list(range(1, n + 1)) and offsets.tolist() == np.concatenate([[0], np.cumsum(np.arange(1, n + 1))])[:-1].tolist()
    if n:
        assert not index.locate(np.arange(1000, dtype=np.int64) * 2 + 1, np.full(1000, 9, np.uint32))[0].any()


def test_round_trip(spark):
    rows = [(i * 3 - 4, t, "x") for i, t in enumerate(TEXTS)] + [(2, "Hello", "y"), (None, "null id", "z"), (50, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest, folder = ti.write_token_ids(df, PATH)
    got = sorted(map(tuple, ti.read_token_ids(manifest, folder).collect()), key=lambda r: r[1])
    enc = ti.encoder(PATH)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start, by_id = 0, {}
    for i, at, n, crc in got:
        assert at == start
        start += n
        by_id.setdefault(i, []).append((n, crc))
    for i, t, _ in rows:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in by_id[i]
    assert ti.lookup(manifest, folder, 50).tolist() == [1]
    assert ti.lookup(manifest, folder, 2, 1) is not None
    assert ti.lookup(manifest, folder, 12345) is None


def test_no_documents(spark):
    manifest, folder = ti.write_token_ids(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert ti.read_token_ids(manifest, folder).collect() == []
