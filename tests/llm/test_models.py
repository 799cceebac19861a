import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id as li
from factloom.llm import quality as ql
from factloom.session import table

SF = "/root/testdata/sf0.01"


def test_features_handle_odd_texts():
    texts = ["", " ", "a", "WORD!! WORD!!", "é" * 5, "x" * 70_000, "\n\n", "ab ab ab"]
    x = ql.features(pa.array(texts))
    assert x.shape == (len(texts), len(ql.FEATURES)) and np.isfinite(x).all()
    assert (ql.features(pa.array(texts).slice(3, 1)) == x[3]).all()
    f = dict(zip(ql.FEATURES, x[3], strict=True))
    assert f["upper"] == pytest.approx(8 / 13) and f["marked_words"] == 1 and f["distinct_words"] == 0.5


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = ql.AdditiveModel.fit(x, y)
    t = rng.uniform(-1, 1, (1000, 3))
    assert ((m.score(t) > 0.5) == ((t[:, 0] > 0) ^ (t[:, 1] > 0))).mean() > 0.93
    assert (0, 1) in [(i, j) for i, j, _ in m.pairs]


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = ql.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x y", 1), (2, "", 1), (3, "w " * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ql.quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert ql.quality_scores(docs.limit(0), labels).count() == 0


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    got = li.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    seen = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(seen[0], "the cat sat on the mat", "en"), (seen[1], "le chat est sur la table", "fr"), (1, None, "en"), (2, "123 ...", "en"), (None, "the mat", None), (4, "", None), (5, "the cat " * 9000, None), (7, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in li.identify_language(df).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    assert got[5].lang_pred == "en" and got[None].lang_pred == "en"
    assert {r.lang_pred for r in li.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert li.identify_language(df.limit(0)).count() == 0


def test_bundle_equals_the_sum_of_bound_vectors():
    of, grams, letters = li.trigrams(["ab a", None, "?"])
    assert letters.tolist() == [True, False, False]
    a, b = 1, 2
    assert sorted(grams[of == 0].tolist()) == sorted([(0 << 12) | (a << 6) | b, (a << 12) | (b << 6), (b << 12) | (0 << 6) | a, (0 << 12) | (a << 6)])
    v = li._letters()[1]
    assert (li.trigram_vectors(np.array([(a << 12) | (b << 6) | a]))[0] == np.roll(v[a], 2) * np.roll(v[b], 1) * v[a]).all()


def test_astral_symbols_are_letters_only_where_they_are():
    from factloom.llm.language_id import trigrams

    of, grams, letters = trigrams(["\U0001f600\U0001f601", "a\U0001f600b", "a b", "\U00020000\U00020001"])
    assert letters.tolist() == [False, True, True, True]
    assert grams[of == 1].tolist() == grams[of == 2].tolist() and not (of == 0).any()
