"""Registered queries read whole tables and whole texts."""

from factloom import catalog


def given(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def run(spark, name, path):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, path).collect())


def test_number_extraction_reads_long_texts(spark, tmp_path):
    texts = [(1, "1,000 and 2.5"), (2, "word " * 600 + "7 then -3"), (3, ""), (4, None), (5, "9 " * 5000)]
    path = given(spark, tmp_path, documents=(texts, "doc_id long, text string"))
    assert run(spark, "number_extraction", path) == [(1, 2, 1002.5), (2, 2, 4.0), (3, 0, 0.0), (4, 0, 0.0), (5, 5000, 45000.0)]


def test_ocr_confidence_route_reads_long_pages(spark, tmp_path):
    long = ["alpha", "beta", "gamma", *[f"filler{i}" for i in range(300)], "ALPHA!", "alphabet", "am", "x" * 3000]
    path = given(spark, tmp_path, documents=([(1, "one two three one"), (2, " ".join(long))], "doc_id long, text string"))
    want = []
    for i, tokens in ((1, ["one", "two", "three", "one"]), (2, long)):
        keys = ["".join(c for c in t.lower() if c.isalnum()) for t in tokens]
        hits = [60 + (p * 7 + i) % 40 for p, t in enumerate(keys) if any(t in w or w in t for w in keys[:3])]
        mean = round(sum(hits) / len(hits), 1)
        want.append((i, "VERIFIED_OCR" if mean >= 80 else "ESTIMATED", mean, mean < 80))
    assert run(spark, "ocr_confidence_route", path) == want


def test_reading_order_reads_all_items(spark, tmp_path):
    path = given(spark, tmp_path, lineitem=([(1, 5, 1, "A"), (900, 5, 2, "B"), (901, 6, 1, "C")], "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string"))
    assert run(spark, "reading_order", path) == [(5, 1, 1, "B"), (5, 1, 2, "A"), (6, 1, 1, "C")]


def test_recall_at_k_reads_all_questions(spark, tmp_path):
    path = given(spark, tmp_path, embeddings=([(i,) for i in range(200, 500)], "vec_id long"))  # page 7 q mod 30 stands at rank 7
    assert run(spark, "recall_at_k", path) == [(1.0,)]


def test_eval_prf_reads_all_documents(spark, tmp_path):
    path = given(spark, tmp_path, documents=([(i,) for i in range(1, 6)], "doc_id long"), labels=([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int"))
    assert run(spark, "eval_prf", path) == [(1, 1.0, 1.0, 1.0, True), (2, 0.0, 0.0, 0.0, False), (3, 1.0, 0.0, 0.0, True), (4, 1.0, 1.0, 1.0, True), (5, 1.0, 0.0, 0.0, True)]


def test_verification_reads_all_languages_and_lengths(spark, tmp_path):
    body = " ".join(f"wort{i}" for i in range(40))
    rows = [(6, "en", body), (12, "de", body), (18, None, body), (24, "fr", "kurz"), (30, "en", ""), (36, "en", None), (22, "de", body)]
    path = given(spark, tmp_path, documents=(rows, "doc_id long, lang string, text string"))
    good, lost, bare = (True, None, "VERIFIED"), (False, "QUOTE_NOT_ON_SINGLE_PAGE", "REJECTED"), (False, "PAGE_TEXT_MISSING", "UNVERIFIABLE")
    want = {6: good, 12: good, 18: good, 22: bare, 24: lost, 30: bare, 36: bare}
    assert run(spark, "verify_facts_chain", path) == [(i, *want[i]) for i in sorted(want)]
    assert run(spark, "fail_reason_histogram", path) == [("PAGE_TEXT_MISSING", 3), ("QUOTE_NOT_ON_SINGLE_PAGE", 1), ("VERIFIED", 3)]
    assert run(spark, "verification_rate", path) == [(7, 3, 3 / 7)]
    forms = dict(catalog.QUERIES["normalize_verification"](spark, path).collect())
    assert set(forms) == set(want) and forms[6] == forms[12] == forms[18] and forms[36] is None


def cut_quotes(spark, tmp_path):
    """Pages whose proposed quote begins or ends in a word, and one without text."""
    body = " ".join(f"wort{i}" for i in range(40))
    rows = [(2, "en", "El El El El " * 9), (8, "en", body), (14, "fr", "abcd" + body[:35] + " au\u00e9l" + body), (20, "en", None)]
    return given(spark, tmp_path, documents=(rows, "doc_id long, lang string, text string"))


def test_quotes_cut_within_a_word_are_counted(spark, tmp_path):
    assert run(spark, "fail_reason_histogram", cut_quotes(spark, tmp_path)) == [("PAGE_TEXT_MISSING", 1), ("VERIFIED", 3)]


def test_ingest_publishes_quotes_cut_within_a_word(spark, tmp_path):
    assert dict(run(spark, "ingest_counts", cut_quotes(spark, tmp_path)))["published"] == 3


def test_rate_counts_quotes_cut_within_a_word(spark, tmp_path):
    assert run(spark, "verification_rate", cut_quotes(spark, tmp_path)) == [(4, 3, 0.75)]


def test_quotes_cut_within_a_word_are_verified(spark, tmp_path):
    assert run(spark, "verify_facts_chain", cut_quotes(spark, tmp_path))[:3] == [(i, True, None, "VERIFIED") for i in (2, 8, 14)]


def test_quote_samples_match_brute_force(spark, tmp_path):
    a, b, c = "A heading with: a colon in it", "A line that ends in a full stop.", "Some words that run on well-known"
    d, e = "into the next line with 12 words", "and \u201cone more\u201d that nothing follows"
    texts = {1: [a, d, "short", c, "", d, c, d, e], 2: [b, d], 3: [d, "short", e], 4: ["short"], 5: [f"  {c}  ", e, d]}
    path = given(spark, tmp_path, documents=([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    want = []
    for i, raw in texts.items():
        lines = [x.strip(" ") for x in raw]
        fits = {
            "single_line": lines, "numeric": [x for x in lines if "1" in x], "hyphenated": [x for x in lines if "l-k" in x], "typographic": [x for x in lines if "\u201c" in x],
            "multi_line": [f"{x} {y}" for x, y in zip(lines, lines[1:], strict=False) if len(x) >= 20 <= len(y) and x[-1] != "." and ":" not in x],
        }
        for kind, found in fits.items():
            want += [(i, 1, kind, x) for x in found if len(x) >= 20][:1]
    assert run(spark, "quote_samples", path) == sorted(want)
    assert {(i, q) for i, _, kind, q in want if kind == "multi_line"} == {(1, f"{d} {c}"), (5, f"{c} {e}")}
