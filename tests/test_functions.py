import pytest
from pyspark.sql import functions as F

from factloom.functions import geo as G
from factloom.functions import numbers as N
from factloom.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  a \t b c  d ", "a b c d"),
        ("“quoted” – ‘it’ − ﬁle ﬃ", "\"quoted\" - 'it' - file ffi"),
        ("com-\n prehensive so\xadft", "comprehensive soft"),
        ("a- b", "a- b"),
    ],
)
def test_canonical(spark, raw, want):
    assert value(spark, X.canonical(F.lit(raw))) == want


def test_verification_form(spark):
    assert value(spark, X.verification_form(F.lit("₹ 5 Crores and 3 Lakhs, INR 2 cr"))) == "rs 5 crore and 3 lakh, rs 2 crore"


def test_find_quote_tiers(spark):
    page = "Total  of “5” crores"
    for quote, tier, start in (("of “5”", "exact", 7), ('Total of "5"', "canonical", 0), ("TOTAL OF \"5\" CRORE", "verification", 0), ("none", None, -1)):
        got = value(spark, X.find_quote(F.lit(page), F.lit(quote)))
        assert (got.tier, got.start, got.matched) == (tier, start, tier is not None)


def test_quotes_cut_within_a_word_are_found(spark):
    page = "Annual  grants of 5 crore for the macr\u00f3 plan"
    for quote, tier in (("L GRANTS", "lower"), ("ANNUAL GRANTS", "verification"), ("L GRANTZ", None)):
        got = value(spark, X.find_quote(F.lit(page), F.lit(quote)))
        assert (got.tier, got.matched, got.exact) == (tier, tier is not None, False)


def test_tokens_and_overlap(spark):
    assert value(spark, X.tokens(F.lit("The cat, sat ON it!"))) == ["the", "cat", "sat"]
    assert value(spark, X.token_overlap(F.lit("the cat ran"), F.lit("a cat; the dog"))) == pytest.approx(2 / 3)
    assert value(spark, X.token_overlap(F.lit("a b"), F.lit("a b"))) == 0.0


def test_splits(spark):
    assert value(spark, X.paragraphs(F.lit("short\n\n  a paragraph that is long enough  "))) == ["a paragraph that is long enough"]
    assert value(spark, X.paragraphs(F.lit("short"))) == ["short"]
    assert value(spark, X.windows(F.lit("x" * 2001))) == ["x" * 1000, "x" * 1000, "x"]
    assert value(spark, X.sentences(F.lit("This is a long sentence here. Another long sentence is there. No."))) == ["This is a long sentence here.", "Another long sentence is there."]


def test_labels_and_scrubbing(spark):
    assert value(spark, X.glossary_term(F.lit("Outlay: money spent"))) == "Outlay"
    assert value(spark, X.glossary_term(F.lit("A ward means an area"))) == "A ward"
    assert value(spark, X.short_label(F.lit("x" * 30))) == "x" * 26 + "..."
    assert value(spark, X.scrub_secrets(F.lit("k gsk_abc AIza" + "y" * 20))) == "k [REDACTED_GSK] [REDACTED_AIZA]"
    assert value(spark, X.scrub_map(F.create_map(F.lit("Password"), F.lit("p"), F.lit("note"), F.lit("gsk_1")))) == {"Password": "[REDACTED]", "note": "[REDACTED_GSK]"}
    assert value(spark, X.place_key(F.lit("State of Goa, District"))) == "goa"
    assert value(spark, X.human_bytes(F.lit(1536))) == "1.5 KB"
    assert value(spark, X.strip_json_fence(F.lit("```json\n{}\n```"))) == "{}"


def test_numbers(spark):
    assert value(spark, N.parse_float_prefix(F.lit("12abc"))) == 12.0
    assert value(spark, N.extract_numbers(F.lit("1,234 and 2026-27, -.5"))) == [1234.0, 2026.0, -27.0, -0.5]
    assert value(spark, N.plain_text(F.lit(1e7))) == "10000000"
    assert value(spark, N.plain_text(F.lit(5810.02))) == "5810.02"
    assert value(spark, N.grouped(F.lit(1234567.5))) == "1,234,567.5"
    assert value(spark, N.grouped(F.lit(1234567.5), indian=True)) == "12,34,567.5"
    assert value(spark, N.grouped(F.lit(123.0), indian=True)) == "123"
    assert value(spark, N.indian_scale(F.lit(2.0), F.lit("Rs in Lakh"))) == 200000.0
    assert value(spark, N.matches_subset_sum(F.lit(7.0), F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 0.0))
    assert not value(spark, N.matches_subset_sum(F.lit(8.0), F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 0.0))
    assert value(spark, N.computed_twice(F.lit(1.0), F.lit(1.00005)))["proof_type"] == "COMPUTED"
    assert value(spark, N.computed_twice(F.lit(1.0), F.lit(51.0)))["proof_type"] == "REJECTED"
    assert value(spark, N.computed_twice(F.lit(1.0), F.lit(float("nan"))))["reason"] == "not a number"
    assert value(spark, N.image_size_ok(F.lit(10_000), F.lit(4_000))) and not value(spark, N.image_size_ok(F.lit(10_000), F.lit(4_001)))


def test_geo(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))])
    assert tuple(value(spark, G.centroid(ring))) == (2.0, 1.0)
    assert tuple(value(spark, G.bbox(ring))) == (0.0, 0.0, 4.0, 2.0)
    assert tuple(value(spark, G.normalized(F.lit(111319.490793), F.lit(0.0)))) == (1.0, 0.0)
    assert value(spark, G.normalized(F.lit(0.0), F.lit(1e9)))["lat"] == pytest.approx(85.051129)
    box = F.struct(F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(4.0).alias("east"), F.lit(2.0).alias("north"))
    assert value(spark, G.svg_path(F.slice(ring, 1, 2), box, 100, 50)) == "M 0.00 50.00 L 100.00 50.00 Z"
    assert value(spark, G.missing_members(F.array(F.lit("a.SHP"), F.lit("a.dbf")))) == [".shx"]
    assert value(spark, G.archive_faults(F.lit(300), F.lit(1), F.lit(100))) == ["TOO_MANY_FILES", "RATIO"]
    assert value(spark, G.equal_classes(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 2
