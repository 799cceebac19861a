import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import sentencepiece_scan
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import mix
from factloom.llm.quality import quality_scores
from factloom.llm.queries import vocabulary
from factloom.session import table

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "encoding"]


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = table(spark, SF, "documents").withColumn("extra", F.col("doc_id") * 2)
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
        if name != "encoding":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality":
            bad = quality_scores(before, table(spark, SF, "labels")).filter("predicted = 0").select("doc_id")
            assert docs.join(bad, "doc_id", "left_semi").count() == 0 and docs.count() + bad.count() == kept[0]
        if name == "exact":
            assert docs.count() == before.select("text").distinct().count()
    assert kept[0] > kept[1] > kept[2] >= kept[3] > kept[4] == kept[5]
    assert docs.filter("not round_trip").count() == 0


def test_stages_take_an_empty_table(spark):
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_judge_rows_not_ids(spark):
    """Rows that share an id: other texts are judged apart, equal rows leave one, and null ids are judged like others."""
    rows = [(1, "same"), (2, "same"), (2, "only here"), (5, "b b"), (5, "b b"), (None, "same"), (None, "alone"), (None, "twice"), (None, "twice"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row_key", "2 AS doubt", "3 AS `own_source`", "'en' AS lang", "'web' AS source")
    kept = corpus_pipeline.exact_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", "same"), ("2", "only here"), ("5", "b b"), ("None", "alone"), ("None", "twice"), ("7", None)], key=str)
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, near), (1, "quite another text of seven words"), (None, near + " thirteen"), (3, f"{near} fourteen"), (None, "nothing like the others at all"), (4, "plain"), (4, "simple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row_key", "2 AS row_number", "'x' AS doubt")
    kept = corpus_pipeline.near_stage(spark, docs, SF)
    texts = sorted(r["text"] for r in kept.collect())
    assert kept.columns == docs.columns and len([t for t in texts if t.startswith("one two")]) == 1 and len(texts) == 5
    wide = spark.createDataFrame([(i % 3, f"text {i}", "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS own_chance", "2 AS own_number", "3 AS own_topic")
    assert corpus_pipeline.mixing_stage(spark, wide, SF).columns == wide.columns
    scored = corpus_pipeline.quality_stage(spark, docs.selectExpr("*", "'en' AS lang"), SF)
    assert scored.count() <= docs.count() and "lang" in scored.columns


def test_stages_match_their_operators(spark):
    """What each filtering stage keeps, against the operator's own decisions on the same rows."""
    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert ids(corpus_pipeline.exact_stage(spark, docs, SF)) == sorted(first.values())
    assert ids(corpus_pipeline.near_stage(spark, docs, SF)) == ids(near_duplicates(docs, k=5, percent=80).filter("kept"))
    assert ids(corpus_pipeline.mixing_stage(spark, docs, SF)) == ids(mix(docs).filter("selected"))


def test_encoding_leaves_nothing_in_workers(spark, monkeypatch):
    """No worker function of the stage leaves a vocabulary behind, those of giant texts included."""
    whole = type(spark.range(1)).mapInArrow

    def watched(df, func, *args, **more):
        def run(batches):
            sentencepiece_scan.vocabulary_of.cache_clear()  # what other tests left
            yield from func(batches)
            if sentencepiece_scan.vocabulary_of.cache_info().currsize:
                raise RuntimeError("a vocabulary is left")

        return whole(df, run, *args, **more)

    rows = [(i, f"some words of text {i}") for i in range(20)] + [(-1, "so much giant text " * 8000), (-2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    got = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
    monkeypatch.undo()
    kept = sentencepiece_scan.encode_and_check(docs, vocabulary("piece_bpe_32k.model"), keep_ids=True).collect()
    assert sorted(got) == sorted(kept) and len(got) == 22 and all(r["round_trip"] for r in got)
