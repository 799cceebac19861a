from factloom.operators import integrity as I
from factloom.operators import proposals as P


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_constraints(spark):
    docs = spark.createDataFrame([(1, "o", "h", 50, "done"), (2, "o", "h", 101, "lost"), (3, "o", "g", None, "queued")], "document_id int, owner_id string, sha256 string, progress int, status string")
    assert rows(I.broken_documents(docs).select("document_id", "rule"), "document_id", "rule") == [(2, "PROGRESS_RANGE"), (2, "STATUS"), (3, "PROGRESS_RANGE")]
    assert rows(I.repeated_uploads(docs)) == [("o", "h", 2)]
    facts = spark.createDataFrame([(1, True, None, "money"), (2, True, "VERIFIED", "x"), (3, False, "odd", None)], "fact_id int, verified boolean, proof_type string, fact_type string")
    assert rows(I.broken_facts(facts).select("fact_id", "rule"), "fact_id") == [(1, "VERIFIED_NEEDS_PROOF"), (2, "FACT_TYPE"), (3, "PROOF_TYPE")]
    modal = spark.createDataFrame([(1, "quote", "page_quote", True, None), (2, "quote", "geo_feature", False, None), (3, "manual", "geo_feature", True, "R")], "fact_id int, method string, locator_kind string, verified boolean, fail_reason string")
    assert rows(I.broken_modal_facts(modal).select("fact_id", "rule"), "fact_id", "rule") == [(2, "METHOD_LOCATOR"), (2, "UNVERIFIED_NEEDS_REASON"), (3, "VERIFIED_WITHOUT_REASON")]
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.5, 0.0, 0.6, 0.1), (-0.1, 0.0, 0.1, 0.1)], "x double, y double, width double, height double")
    assert I.boxes_out_of_page(boxes).count() == 2


def test_backfills(spark):
    docs = spark.createDataFrame([(1, None), (2, "audit")], "document_id int, document_type string")
    analyses = spark.createDataFrame([(1, "budget", "t", None), (2, "policy", "", [5])], "document_id int, document_type string, text string, source_fact_ids array<int>")
    assert rows(I.backfill_document_type(docs, analyses), "document_id") == [(1, "budget"), (2, "audit")]
    facts = spark.createDataFrame([(1, 7, True, "image_dimension", "640 x 480"), (1, 6, True, "count", "q"), (2, 8, False, "date", "q")], "document_id int, fact_id int, verified boolean, type string, quote string")
    sources = spark.createDataFrame([(1, None, None), (2, 3, 4)], "document_id int, width int, height int")
    assert rows(I.backfill_image_sizes(sources, facts), "document_id") == [(1, 640, 480), (2, 3, 4)]
    assert I.unsourced_analyses(analyses).count() == 1
    fixed = I.backfill_source_facts(analyses, facts)
    assert {r.document_id: r.source_fact_ids for r in fixed.collect()} == {1: [6, 7], 2: [5]}
    assert I.unsourced_analyses(fixed).count() == 0


def test_api_form(spark):
    df = spark.createDataFrame([("odd", None, 3, "BE 2026-27", None, 1.23456), ("count", "L", 1, None, 2.0, 9.0)], "type string, label string, page int, period string, normalized_value double, value double")
    got = I.scale_normalized(I.api_facts(df)).collect()
    assert (got[0].type, got[0].label, tuple(got[0].period), str(got[0].numeric_value)) == ("allocation", "Fact on page 3", ("BE", "BE 2026-27"), "1.2346")
    assert (got[1].type, got[1].label, got[1].period, str(got[1].numeric_value)) == ("count", "L", None, "2.0000")


def test_replay_order_and_answers(spark):
    chunks = spark.createDataFrame([(1, 0, "h1", "s1", None), (1, 1, "h2", "s1", None), (2, 0, "h3", "s2", "p"), (3, 0, "h9", "s9", None)], "document_id int, chunk int, chunk_hash string, sha string, path string")
    answer = '```json\n[{"type":"allocation","value":5,"unit":"","page":2,"quote":"q"}]\n```'
    rec = spark.createDataFrame([("chunk", "h1", answer), ("document", "1", "[]"), ("document_chunk", "1_h1", answer), ("path", "p", "broken"), ("sha", "s2", answer)], "kind string, key string, answer string")
    got = P.replay(chunks, rec)
    assert {(r.document_id, r.chunk): r.key_used for r in got.collect()} == {(1, 0): "document_chunk", (1, 1): "document", (2, 0): "path", (3, 0): None}
    assert rows(P.parse_answers(got).select("document_id", "fact_type", "label", "value", "unit", "page")) == [(1, "money", "money on page 2", 5.0, None, 2)]
    assert len(P.prompts(spark.createDataFrame([(1, 0, ["a", "b"])], "document_id int, chunk int, texts array<string>"), "Find").first().prompt_hash) == 64


def test_figures(spark):
    text = "The revised estimate for 2026-27 is INR 1,200.5 crore for roads. Another 45 km were laid in the past year. None here at all, sorry."
    got = rows(P.figures_in_text(spark.createDataFrame([(1, 1, text)], "document_id int, page int, text string")).select("value", "unit", "basis", "fiscal_year"), "pos")
    assert got == [(1200.5, "crore", "RE", "2026-27"), (45.0, "km", "none", None)]
