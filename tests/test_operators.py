import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts as A
from factloom.operators import layout as L
from factloom.operators import views as W
from factloom.operators import library as B
from factloom.operators import narrative as T
from factloom.operators import places as P
from factloom.operators import search as S
from factloom.operators import tabular as tab
from factloom.operators import verify as V


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


PAGE = "The outlay for FY 2026-27 is Rs. 1,250 crore for roads.\n9. Technology plan on page 7. Vision @2047 holds."


@pytest.mark.parametrize(
    "page, fact, reason",
    [
        (7, {"quote": "Rs. 1,250 crore for roads", "value": 1250.0, "type": "allocation", "unit": "crore", "period": "2026-27"}, None),
        (8, {"quote": "anything"}, "PAGE_TEXT_MISSING"),
        (7, {"quote": "not there"}, "QUOTE_NOT_ON_SINGLE_PAGE"),
        (7, {"quote": "Vision @2047 holds", "value": 2047.0}, "YEAR_OR_DATE_AS_VALUE"),
        (7, {"quote": "9. Technology plan", "value": 9.0}, "HEADING_NUMBER"),
        (7, {"quote": "plan on page 7", "value": 7.0}, "PAGE_OR_ID_NUMBER"),
        (7, {"quote": "crore for roads", "value": 55.0}, "VALUE_NOT_IN_QUOTE"),
        (7, {"quote": "1,250 crore", "value": 1250.0, "type": "allocation"}, "MISSING_REQUIRED_UNIT"),
        (7, {"quote": "outlay for", "type": "physical_quantity", "unit": "km"}, "UNIT_NOT_IN_QUOTE"),
        (7, {"quote": "The outlay", "period": "1999-00"}, "PERIOD_NOT_IN_QUOTE"),
    ],
)
def test_verification_reasons(spark, page, fact, reason):
    pages = spark.createDataFrame([(1, 7, PAGE)], "document_id int, page int, text string")
    f = {"value": None, "type": None, "unit": None, "period": None} | fact
    facts = spark.createDataFrame([(1, page, f["quote"], f["value"], f["type"], f["unit"], f["period"])], "document_id int, page int, quote string, value double, type string, unit string, period string")
    got = V.verify_facts(facts, pages).first()
    assert (got.fail_reason, got.verified) == (reason, reason is None)
    if reason in ("MISSING_REQUIRED_UNIT", "UNIT_NOT_IN_QUOTE"):
        assert V.verify_facts(facts, pages, check_units=False).first().verified


def test_quotes_meet_pages(spark):
    pages = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "beta gamma")], "page_id long, text string")
    quotes = spark.createDataFrame([(1, "beta gamma delta"), (2, "ta gamma del"), (3, "gamma"), (4, "omega"), (5, "")], "quote_id long, quote string")
    assert rows(V.quotes_on_pages(pages, quotes), "page_id", "quote_id") == [(1, 1, 6), (1, 2, 8), (1, 3, 11), (2, 3, 5)]


def test_quotes_of_every_length_equal_brute_force(spark):
    pick = random.Random(3)
    words = ["ab", "b", "a", "abc", "cab", "x", "xx ", "é", "the", "the"]
    pages = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    quotes = [(900, None), (901, " "), (902, "zz zz zz zz zz zz")]
    for i in range(150):
        text = pages[pick.randrange(60)][1]
        start = pick.randint(0, max(0, len(text) - 1))
        quotes.append((i, text[start : start + pick.randint(0, 14)]))
    got = V.quotes_on_pages(spark.createDataFrame(pages, "page_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string"))
    want = [(p, q, text.find(quote)) for p, text in pages if text for q, quote in quotes if quote and quote.strip() and quote in text]
    assert rows(got, "page_id", "quote_id") == sorted(want)


def test_dashes_joined_only_once(spark):
    pages = spark.createDataFrame([(1, 1, "INCOME– tax rose")], "document_id int, page int, text string")
    facts = spark.createDataFrame([(1, 1, "income– tax", None, None, None, None)], "document_id int, page int, quote string, value double, type string, unit string, period string")
    got = V.verify_facts(facts, pages).first()
    assert got.verified and not got.exact_match


def test_type_inference_and_limits(spark):
    df = spark.createDataFrame([("$45,000,000", "15.5%", "2024-01-15", "12345", "Ward 1", "¥5"), ("n/a", "", "2024/2/3", "-2", "x", "6"), ("$1", "1%", "2024-12-31", "null", "3", "¥7")], "a string, b string, c string, d string, e string, f string")
    assert dict(rows(tab.infer_types(df))) == {"a": "currency", "b": "percentage", "c": "date", "d": "number", "e": "string", "f": "string"}
    with pytest.raises(tab.TableLimitError):
        tab.check_limits(spark.range(3), max_rows=2)
    with pytest.raises(tab.TableLimitError):
        tab.check_limits(df, max_columns=5)


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (4.0, 2.0), (100.0, None)], "a double, k double")
    assert rows(tab.quartiles(df), "column") == [("a", 2.0, 4.0), ("k", 2.0, 2.0)]
    assert rows(tab.outliers(df)) == [("a", 100.0, 1)]
    assert rows(tab.pearson_pairs(df)) == [("a", "k", 4, 0.0)]
    assert [r.n for r in tab.histogram(df, "a").orderBy("bin").collect()] == [4, 0, 0, 0, 1]
    assert tab.histogram(df.limit(3), "a").count() == 0
    assert tab.profile(df.limit(0)).count() == 0
    assert tab.column_roles(spark.range(1).select(F.lit(1).alias("population"), F.lit(1).alias("Start Year")))["date"] == ["Start Year"]


def _facts(spark, data):
    schema = "document_id int, fact_id int, row_idx int, label string, type string, value double, unit string, currency string, basis string, fiscal_year string, page int, quote string, verified boolean, proof_type string"
    base = {"document_id": 1, "label": "l", "type": "allocation", "value": 1.0, "unit": "crore", "currency": "INR", "basis": None, "fiscal_year": None, "page": 1, "quote": "q", "verified": True, "proof_type": None}
    made = [base | {"fact_id": i, "row_idx": i} | d for i, d in enumerate(data)]
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in made], schema)


@pytest.mark.parametrize("accuracy", [1, 10_000])
def test_order_statistics_against_sorting(spark, monkeypatch, accuracy):
    monkeypatch.setattr(tab, "ACCURACY", accuracy)  # poor cuts cost time only
    rng = random.Random(3)
    sets = {
        "one": [5.0],
        "two": [2.0, -7.5],
        "same": [1.0] * 400,
        "ties": [float(rng.randrange(4)) for _ in range(401)],
        "spread": [rng.lognormvariate(0, 9) for _ in range(1000)],
        "nan": [float("nan")] * 3 + [0.0] * 2,
    }
    for values in sets.values():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = tab.quartiles(df).join(tab.medians(df), "column").first()
        ranked, n = sorted(values, key=lambda v: (v != v, v)), len(values)
        a, b = ranked[(n - 1) // 2], ranked[n // 2]
        want = (ranked[n // 4], ranked[3 * n // 4], a if a == b else 0.5 * a + 0.5 * b)
        assert [repr(x) for x in (got["q1"], got["q3"], got["median"])] == [repr(x) for x in want]
    assert tab.medians(spark.createDataFrame([], "v double")).count() == 0


def test_dominant_unit_ties_go_to_the_first_seen(spark):
    facts = _facts(spark, [{"unit": "km"}, {"unit": "crores"}, {"unit": "cr"}, {"unit": "km"}])
    assert {r.unit_name for r in A.dominant(facts).collect()} == {"km"}


def test_charts_need_enough_facts(spark):
    kinds = lambda n: {r.kind for r in A.chart_candidates(_facts(spark, [{"value": float(i + 1), "fiscal_year": str(2000 + i)} for i in range(n)])).collect()}
    assert kinds(1) == {"key_figures_strip", "bullet_gauge"}
    assert kinds(2) == {"key_figures_strip", "donut_pie", "slope_chart", "grouped_stacked_bar", "bullet_gauge"}
    assert kinds(7) == {"key_figures_strip", "treemap", "horizontal_ranked_bar", "line_area", "grouped_stacked_bar", "bullet_gauge"}
    assert A.chart_candidates(_facts(spark, [{"verified": False}])).count() == 0


def test_conflicts(spark):
    facts = _facts(spark, [{"value": 1.0}, {"value": 1.005}, {"value": 2.0}, {"value": 3.0, "fiscal_year": "2020"}])
    assert rows(A.conflicts(facts).select("a_id", "b_id"), "a_id", "b_id") == [(0, 2), (1, 2)]


def test_conflict_classes_of_a_crowded_key(spark):
    many = spark.range(100_000).selectExpr("1L as document_id", "id as fact_id", "id as row_idx", "'Total' as type", "cast(null as string) as fiscal_year", "case when id = 7 then 5.0D when id = 9 then 5.005D else 2.0D end as value")
    got = sorted((r.value, r.first_id, r.facts, r.links) for r in A.conflict_classes(many).collect())
    assert got == [(2.0, 0, 99_998, 2), (5.0, 7, 1, 99_998), (5.005, 9, 1, 99_998)]
    assert A.conflict_classes(many.filter("fact_id in (7, 9)")).count() == 0 and A.conflict_classes(many.limit(0)).count() == 0


def test_claims(spark):
    facts = _facts(spark, [{"value": 30.0, "label": "Roads works"}, {"value": 70.0, "label": "Water works"}])
    claims = spark.createDataFrame(
        [
            ("sum", "Together 100 crore", [0, 1]), ("share", "Roads hold 30% of it", [0, 1]), ("bad", "It is 55 crore", [0, 1]), ("none", "x", [9]),
            ("wrong", "Roads is more than Water", [0, 1]), ("right", "Water is more than Roads", [0, 1]), ("year", "In 2024 it was 30", [0]),
        ],
        "claim_id string, text string, fact_ids array<int>",
    )
    got = {r.claim_id: (r.proof_type, r.reason) for r in T.ground_claims(claims, facts).collect()}
    assert got == {
        "sum": ("VERIFIED", None), "share": ("VERIFIED", None), "bad": ("REJECTED", "number"), "none": ("REJECTED", "no fact"),
        "wrong": ("REJECTED", "comparison"), "right": ("VERIFIED", None), "year": ("VERIFIED", None),
    }


def test_insights_hold_at_every_level(spark):
    facts = _facts(spark, [{"value": v, "label": n} for v, n in ((60.0, "Roads"), (30.0, "Water"), (10.0, "Parks"))])
    series = A.chart_candidates(facts).filter("kind = 'horizontal_ranked_bar'")
    for level, n in (("simple", 2), ("standard", 3), ("expert", 3)):
        assert T.grounded_insights(series, facts, level).count() == n


def test_storyboard_falls_back(spark):
    steps = T.storyboard(_facts(spark, [{"quote": "zzz", "label": "zzz", "type": "x"}] * 3)).groupBy("step").count()
    assert dict(rows(steps)) == {1: 1, 2: 3, 3: 3, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2}


def test_pack_pages(spark):
    pages = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((10, 50, 50, 5, 5, 5, 5))], "document_id int, page int, text string")
    got = rows(S.pack_pages(pages, 4, 100).select("chunk", "pages", "chars"), "chunk")
    assert got == [(0, [0, 1], 60), (1, [2, 3, 4, 5], 65), (2, [6], 5)]


def test_search_handles_zero_vectors_and_empty_queries(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "the cat"), (2, [0.0, 0.0], "a dog"), (3, [1.0, 1.0], "the cat cat")], "id int, embedding array<double>, text string")
    assert [r.id for r in S.vector_top(chunks, [1.0, 0.0], "id").collect()] == [1, 3]
    assert rows(S.keyword_top(chunks, "Cat?", "id")) == [(3, 1, 2), (1, 1, 1)]
    assert S.keyword_top(chunks, "a", "id").count() == 0


def test_places(spark):
    gaz = spark.createDataFrame([("a", "Bilaspur", "S1", "IN", ["Old Bilaspur"]), ("b", "Bilaspur", "S2", "IN", None), ("c", "Goa", None, "IN", [])], "place_id string, name string, parent_code string, country_code string, aliases array<string>")
    recs = spark.createDataFrame([(1, "District of Bilaspur", None, None), (2, "BILASPUR", "S2", None), (3, "bilaspur", "S9", None), (4, "old bilaspur", None, "IN"), (5, "nowhere", None, None), (6, None, None, None)], "record_id int, name string, parent string, country string")
    got = {r.record_id: (r.status, r.place_id) for r in P.lookup_places(recs, gaz).collect()}
    assert got == {1: ("ambiguous", None), 2: ("exact", "b"), 3: ("ambiguous", None), 4: ("exact", "a"), 5: ("not_found", None), 6: ("not_found", None)}


def test_records_that_ask_the_same_meet_places_once(spark):
    gaz = spark.range(300).selectExpr("id AS place_id", "'Goa' AS name", "id % 3 AS parent_code", "'X' AS country_code", "array(concat('alias ', id)) AS aliases")
    recs = spark.range(400).selectExpr("id AS record_id", "if(id % 2 = 0, 'goa', concat('ALIAS ', id)) AS name", "id % 4 AS parent", "cast(null AS string) AS country")
    assert P.candidates(recs, gaz).count() == 100 + 100 + 150  # goa of parents 0 and 2, each alias once
    counts = {r.part: r.n for r in P.partition_sizes(P.lookup_places(recs, gaz)).collect()}
    assert counts == {"matched": 150, "ambiguous": 200, "unmatched": 50} == {k: df.count() for k, df in P.partition_places(P.lookup_places(recs, gaz)).items()}


def test_lookup_answers_every_record_of_a_question(spark):
    gaz = spark.createDataFrame([(1, "Goa", 5, "IN", ["A"]), (1, "Goa", 6, "IN", ["A"]), (2, "goa", None, "PT", None), (3, "b", 3, "IN", ["a"])], "place_id long, name string, parent_code long, country_code string, aliases array<string>")
    asked = [("GOA", 5, None), ("goa", 5, None), ("Goa", None, None), ("goa.", None, "PT"), ("a", 1, None), ("a", None, "PT"), ("a", 3, "IN"), ("", 5, "IN"), (None, None, None)] * 2
    got = P.lookup_places(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "record_id int, name string, parent long, country string"), gaz)
    want = [("exact", 1, 1), ("exact", 1, 1), ("ambiguous", 2, None), ("exact", 1, 2), ("exact", 1, 1), ("ambiguous", 2, None), ("exact", 1, 3), ("not_found", 0, None), ("not_found", 0, None)] * 2
    assert [tuple(r)[1:] for r in got.orderBy("record_id").collect()] == want
    assert P.candidates(spark.createDataFrame([(i, "goa", None, None) for i in range(50)], "record_id int, name string, parent long, country string"), gaz).count() == 3


def test_reading_order_reads_columns(spark):
    items = [(1, 1, i, f"L{i}", 50.0, 700.0 - 20 * i, 100.0) for i in range(6)] + [(1, 1, 10 + i, f"R{i}", 400.0, 700.0 - 20 * i, 100.0) for i in range(6)]
    df = spark.createDataFrame(items, "document_id int, page int, seq int, str string, x double, y double, width double")
    assert [r.text for r in L.reading_order(df).orderBy("line").collect()] == [f"L{i}" for i in range(6)] + [f"R{i}" for i in range(6)]
    assert [r.text for r in L.reading_order(df.filter("seq % 10 < 5")).orderBy("line").collect()][0] == "L0 R0"


def test_money_mentions(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Road works Rs. 1,200.5 crore this year"), (1, 1, 2, "road works  rs 1,200.5 Crore again"), (1, 1, 3, "nothing here at all"), (1, 2, 1, "Road works Rs. 3 lakh")], "document_id int, page int, line int, text string")
    assert rows(L.money_mentions(lines).select("page", "value", "scaled_value", "unit"), "page") == [(1, 1200.5, 12005000000.0, "crore"), (2, 3.0, 300000.0, "lakh")]


def test_money_mentions_of_all_kinds(spark):
    said = ["Grant for roads Rs. 5,000 in all", "Total: Rs 12 million", "Total -: 7.5 lakh left", "Rs. 4 thousand", ":- Rs. 9 only", "Rs. , nothing said", "cost 40 units only", "Rs. 1.2.3 odd", "a crore of Rs 2 each", "short Rs 1", "x" * 240 + " Rs 5 crore"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(said)], "document_id int, page int, line int, text string")
    got = {r["line"]: (r["label"], r["value"], r["scaled_value"], r["unit"]) for r in L.money_mentions(lines).collect()}
    assert got == {
        0: ("Grant for roads", 5000.0, 5000.0, "INR"), 1: ("Total", 12.0, 12.0, "INR"), 2: ("Total", 7.5, 750000.0, "lakh"), 3: ("Budget Allocation", 4.0, 4.0, "INR"),
        4: ("Fiscal Metric", 9.0, 9.0, "INR"), 7: ("Budget Allocation", 1.2, 1.2, "INR"), 8: ("a crore of", 2.0, 2e7, "crore"), 9: ("short", 1.0, 1.0, "INR"),
    }
    assert {(r["currency"], r["stage"]) for r in L.money_mentions(lines).collect()} == {("INR", "proposed")}


def test_money_facts_are_verified_on_their_page(spark):
    lines = spark.createDataFrame([(1, 1, 1, "NOTICE"), (1, 1, 2, "Total revenue receipts Rs. 5,810.02 crore"), (1, 1, 3, "Section 12 crore plan for roads"), (1, 1, 4, "Page 1 of 2"), (1, 2, 1, "NOTICE"), (1, 2, 2, "Works 3 lakh")], "document_id int, page int, line int, text string")
    got = sorted((r["page"], r["line"], r["value"], r["unit"], r["stage"], r["verified"], r["fail_reason"]) for r in W.money_facts(lines).collect())
    assert got == [(1, 2, 5810.02, "crore", "verified", True, None), (1, 3, 12.0, "crore", "flagged", False, "HEADING_NUMBER"), (2, 2, 3.0, "lakh", "verified", True, None)]


def test_library(spark):
    docs = spark.createDataFrame([(1, "A Budget.pdf", "done", 5, 1), (2, "b.csv", "failed", 9, 2), (3, "c.csv", "extracting", 7, 3)], "document_id int, name string, status string, size_bytes int, created_at int")
    ids = lambda **k: [r.document_id for r in B.search_library(docs, **k).collect()]
    assert ids() == [3, 2, 1] and ids(sort="size") == [2, 3, 1] and ids(text="budget") == [1] and ids(status="processing") == [3] and ids(extensions=("csv",), sort="oldest") == [2, 3]
    assert B.page_of(docs, 500).count() == 3
