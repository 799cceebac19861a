import re

from pyspark.sql import functions as F

from factloom.operators import views as W
from factloom.streaming import events as E


def test_image_guard_looks_at_marks_size_and_side(spark):
    rows = [("ffd8ffe00010ffe1aa", 9, 10, 10), ("ffd8ff0ffe1000", 7, 10, 10), ("ffd8ffe1", 4, 10, 10), ("4d4d002a00", 5, 8000, 1), ("89504e470d0a1a", 7, 1, 1), ("89504e470d0a1a0a", W.IMAGE_BYTES + 1, 0, 1), ("89504e470d0a1a0a", 8, 0, 1)]
    df = spark.createDataFrame(rows, "h string, n int, w int, s int").select(W.image_guard(F.unhex("h"), F.col("n"), F.col("w"), F.col("s")).alias("g"))
    assert [tuple(r.g) for r in df.collect()] == [
        ("image/jpeg", None, True), ("image/jpeg", None, False), ("image/jpeg", None, False), ("image/tiff", None, False),
        (None, "UNSUPPORTED_FORMAT", False), ("image/png", "FILE_TOO_LARGE", False), ("image/png", "IMAGE_DIMENSIONS_EXCEEDED", False),
    ]


def _wrap(x):
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def test_tfidf_hashes_wrap_as_32_bit_integers(spark):
    word = "zebras"
    h = 5381
    for c in word:
        h = _wrap(h << 5) + h + ord(c)
    want = {abs(h) % 768: 1.0 if h % 2 == 0 else -1.0}
    for i in range(len(word) - 2):
        g = 0x811C9DC5
        for c in word[i : i + 3]:
            g = _wrap((g ^ ord(c)) * 0x01000193)
        want[abs(g) % 768] = want.get(abs(g) % 768, 0) + (0.4 if g % 2 == 0 else -0.4)
    norm = sum(x * x for x in want.values()) ** 0.5
    idf = spark.createDataFrame([], "word string, idf double")
    got = W.tfidf_embedding(spark.createDataFrame([(1, "Zebras, zebras of it"), (2, None), (3, "")], "id long, text string"), idf, "id").collect()
    assert {r.bucket: r.weight for r in got if r.id == 1} == {b: round(x / norm, 6) for b, x in want.items() if round(x, 6)}
    assert {r.id for r in got} == {1}


def test_ingest_reaches_done_or_fails(spark):
    pages = spark.createDataFrame([(1, 1, "Total outlay was Rs. 50 crore in the year."), (1, 2, "A second page with enough text."), (2, 1, " "), (2, 2, None)], "document_id long, page int, text string")
    facts = spark.createDataFrame([(1, 1, "outlay was Rs. 50 crore", 50.0, "allocation", None, None), (1, 1, "outlay was Rs. 60 crore", 60.0, "allocation", None, None), (2, 1, "x", None, "statistic", None, None)], "document_id long, page int, quote string, value double, type string, unit string, period string")
    got = W.ingest(pages, facts)
    assert sorted((r.document_id, r.fail_reason or "") for r in got["facts"].collect()) == [(1, ""), (1, "QUOTE_NOT_ON_SINGLE_PAGE"), (2, "QUOTE_NOT_ON_SINGLE_PAGE")]
    assert [r.document_id for r in got["published"].collect()] == [1]
    assert got["chunks"].count() == 2 and got["pages"].count() == 2
    events = got["events"].orderBy("document_id", "sequence").collect()
    assert [r.stage for r in events] == [*E.STAGES, "validating", "failed"] and events[9].progress == 100 and events[-1].status == "failed"
    assert W.of_document(got["events"], 2).count() == 2


def test_dossier_and_empty_tables(spark):
    facts = spark.createDataFrame([(1, 1, True, None, "VERIFIED")], "document_id long, page int, verified boolean, fail_reason string, proof_type string")
    docs = spark.createDataFrame([(1, "a.pdf"), (2, 'b"c.pdf')], "document_id long, filename string")
    empty = spark.createDataFrame([], "document_id long, status string")
    got = {r.document_id: r.dossier for r in W.audit_dossier(docs, facts, empty, empty, empty).collect()}
    assert got[1] == '{"document_id":1,"filename":"a.pdf","facts":1,"verified":1,"pending":0,"conflicts":0,"terms":0}' and '\\"c.pdf' in got[2]
    assert W.viewer_counts(facts.limit(0)).collect() == [] and W.proof_counts(facts).count() == len(W.PROOFS)
    assert W.facts_view(facts, "facts_for_test").count() == 1


def test_embedding_entries_of_a_text_meet_once(spark):
    texts = spark.createDataFrame([(i % 5, f"word{i} other word{i % 3} zebra") for i in range(20)], "id long, text string")
    idf = spark.createDataFrame([("zebra", 1.5), ("other", 2.5)], "word string, idf double")
    got = W.tfidf_embedding(texts, idf, "id")
    assert not re.search(r"hashpartitioning\(id#\d+L, bucket", got._jdf.queryExecution().executedPlan().toString())
    norms = got.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 5 and all(abs(r.n - 1) < 1e-4 for r in norms)
