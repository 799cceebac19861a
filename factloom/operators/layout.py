"""Page layout and recognised text: reading order, running headers, tables, and confidence of recognised tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X

# Fixed values of the layout and recognition contracts.
PAGE_WIDTH, LINE_GAP, SAME_ROW, COLUMN_SLACK = 612.0, 5.0, 4.0, 20.0
COLUMN_ITEMS, COLUMN_SHARE = 5, 0.75
HEADER_SHARE, HEADER_LEAST = 0.3, 2
CONFIDENCE_FLOOR, CHART_CONFIDENCE = 80.0, 50.0
PAGE_MARK = r"(?i)^page\s+\d+(\s+of\s+\d+)?$"
MONEY = r"(?i)(?:rs\.?\s*([0-9,.]+)\s*(?:crore|lakh|million|thousand)?)|(?:\b([0-9,.]+)\s*(?:crore|lakh)\b)"
NO_LABEL, BARE_LABEL, CURRENCY = "Budget Allocation", "Fiscal Metric", "INR"


def reading_order(items: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """document_id, page, line and text from text items (document_id, page, seq, str, x, y, width).

    A page with more than five items on either side of its middle that hold three quarters of all is read column by
    column. Rows are items whose height differs by less than a row's tolerance, taken in fixed bands, so the order
    is total; a narrow item on the middle belongs to its left column and a straddling one stays, on the left.
    """
    page = Window.partitionBy("document_id", "page")
    mid = page_width / 2
    left, right = F.col("x") + F.col("width") <= mid + COLUMN_SLACK, F.col("x") >= mid - COLUMN_SLACK
    n = lambda c: F.count_if(c).over(page)
    rows = items.withColumn("two", (n(left) > COLUMN_ITEMS) & (n(right) > COLUMN_ITEMS) & (n(left) + n(right) >= COLUMN_SHARE * F.count(F.lit(1)).over(page)))
    rows = rows.withColumns({"col": F.when(F.col("two") & right & ~left, 1).otherwise(0), "band": F.round(F.col("y") / SAME_ROW)})
    order = Window.partitionBy("document_id", "page", "col").orderBy(F.desc("band"), "x", "seq")
    rows = rows.withColumn("starts", F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) > LINE_GAP).cast("int"), F.lit(1))).withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("row", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = rows.groupBy("document_id", "page", "col", "row").agg(F.array_sort(F.collect_list(F.struct("nth", "str"))).alias("parts"))
    text = F.trim(F.array_join(F.transform("parts", lambda p: p["str"]), " "))
    at = F.row_number().over(page.orderBy("col", "row"))
    return lines.select("document_id", "page", at.alias("line"), text.alias("text"))


def strip_running_lines(lines: DataFrame) -> DataFrame:
    """Lines (document_id, page, line, text) without running headers and footers: a first or last line that recurs on
    at least max(2, 30 %) of the document's pages, page marks, and bare numbers at the foot. One-page documents stay."""
    page = Window.partitionBy("document_id", "page")
    rows = lines.withColumns({"t": F.trim("text"), "top": F.min("line").over(page), "bottom": F.max("line").over(page)})
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    count = lambda c: rows.filter(c).groupBy("document_id", "t").agg(F.count(F.lit(1)).alias("n"))
    tops = count("line = top and t <> ''").withColumnRenamed("n", "n_top")
    feet = count("line = bottom and bottom > top and t <> ''").withColumnRenamed("n", "n_foot")
    rows = rows.join(pages, "document_id").join(tops, ["document_id", "t"], "left").join(feet, ["document_id", "t"], "left")
    least = F.greatest(F.lit(HEADER_LEAST), F.floor(F.col("pages") * HEADER_SHARE))
    mark = F.col("t").rlike(PAGE_MARK)
    head = (F.col("line") == F.col("top")) & ((F.coalesce("n_top", F.lit(0)) >= least) | mark)
    foot = (F.col("line") == F.col("bottom")) & ((F.coalesce("n_foot", F.lit(0)) >= least) | mark | F.col("t").rlike(r"^\d+$"))
    return rows.filter((F.col("pages") <= 1) | ~(head | foot)).select("document_id", "page", "line", "text")


def scale_of(text: Column) -> Column:
    """STRUCT(label, factor): the number scale that a text names first in the order crore, lakh, million, thousand."""
    low = F.lower(text)
    label = F.when(low.contains("crore"), "crore").when(low.contains("lakh"), "lakh").when(low.contains("million"), "million").when(low.contains("thousand"), "thousand").otherwise("units")
    return F.struct(label.alias("label"), N.indian_scale(F.lit(1.0), label).alias("factor"))


def table_cells(tables: DataFrame) -> DataFrame:
    """table_id, row, col, header, cell, value and scale of raw tables (table_id, text): cells are cut at two blanks or a tab."""
    cut = lambda c: F.transform(F.split(c, r"\s{2,}|\t"), lambda s: F.trim(s))
    rows = tables.select("table_id", scale_of(F.col("text")).alias("scale"), F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0).alias("rows")).filter("size(rows) > 0")
    rows = rows.select("table_id", "scale", cut(F.element_at("rows", 1)).alias("headers"), F.posexplode("rows").alias("row", "line")).filter("row > 0")
    cells = rows.select("table_id", "scale", "headers", "row", F.posexplode(cut(F.col("line"))).alias("col", "cell"))
    bare = F.replace("cell", F.lit(","), F.lit(""))
    value = F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))
    return cells.select("table_id", "row", "col", F.try_element_at("headers", F.col("col") + 1).alias("header"), "cell", value.alias("value"), F.col("scale.label").alias("scale"), F.col("scale.factor").alias("factor"))


def money_mentions(lines: DataFrame) -> DataFrame:
    """document_id, page, line, label, value, scaled_value, unit, currency, stage and quote: the first money figure of
    each line of 10 to 250 characters, once a page, value and label (in any case).

    A figure follows "Rs", with a scale word or without, or stands before crore or lakh. The unit is crore or lakh if the
    line names it anywhere, else INR, and scales the value. The label is the text before the figure, without colons,
    dashes and underscores at its end.
    """
    rows = lines.filter(F.length("text").between(10, 250)).withColumn("m", F.regexp_extract("text", MONEY, 0)).filter("m <> ''")
    digits = F.replace(F.concat(F.regexp_extract("m", MONEY, 1), F.regexp_extract("m", MONEY, 2)), F.lit(","), F.lit(""))
    value = F.regexp_extract(digits, r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")
    unit = F.when(F.lower("text").contains("crore"), "crore").when(F.lower("text").contains("lakh"), "lakh").otherwise(CURRENCY)
    before = F.trim(F.split_part("text", F.col("m"), F.lit(1)))
    label = F.trim(F.regexp_replace(F.when(before == "", NO_LABEL).otherwise(before), "[:_-]+$", ""))
    rows = rows.select("document_id", "page", "line", F.when(label == "", BARE_LABEL).otherwise(label).alias("label"), value.alias("value"), unit.alias("unit"), F.col("text").alias("quote")).filter("value is not null")
    first = F.row_number().over(Window.partitionBy("document_id", "page", "value", F.lower("label")).orderBy("line"))
    scaled = N.indian_scale(F.col("value"), F.col("unit"))
    return rows.withColumn("n", first).filter("n = 1").select("document_id", "page", "line", "label", "value", scaled.alias("scaled_value"), "unit", F.lit(CURRENCY).alias("currency"), F.lit("proposed").alias("stage"), "quote")


def token_confidence(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """candidate_id, confidence (mean of the page's tokens that hold, or are held by, a word of the candidate; one
    decimal) and n, for candidates (candidate_id, page, text) and tokens (page, token, confidence).

    A token meets each candidate of its page once, with all its words; tokens are dealt by page and never sorted.
    """
    words = F.array_distinct(F.filter(F.transform(F.split("text", r"\s+"), X.ocr_key), lambda w: F.length(w) > 0))
    sought = candidates.select("candidate_id", "page", words.alias("words")).filter("size(words) > 0")
    own = tokens.select("page", X.ocr_key(F.col("token")).alias("key"), "confidence").filter("key <> ''")
    met = own.join(sought.hint("shuffle_hash"), "page").filter(F.exists("words", lambda w: F.contains(w, F.col("key")) | F.contains(F.col("key"), w)))
    mean = met.groupBy("candidate_id").agg(F.round(F.avg("confidence"), 1).alias("confidence"), F.count(F.lit(1)).alias("n"))
    return candidates.select("candidate_id").join(mean, "candidate_id", "left").select("candidate_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"))


def route_candidates(scored: DataFrame) -> DataFrame:
    """Candidates (…, confidence, is_chart_element, has_verified_label) with proof_type, confidence and needs_review."""
    bare = F.col("is_chart_element") & ~F.col("has_verified_label")
    sure = F.col("confidence") >= CONFIDENCE_FLOOR
    return scored.withColumns({"proof_type": F.when(~bare & sure, "VERIFIED_OCR").otherwise("ESTIMATED"), "needs_review": bare | ~sure, "confidence": F.when(bare, CHART_CONFIDENCE).otherwise(F.col("confidence"))})


def sample_quotes(pages: DataFrame) -> DataFrame:
    """document_id, page, category and quote: at most one quote a page of each category, the first that fits.

    A multi-line quote is two consecutive lines joined by a blank, the first without a colon and not ending in a dot.
    """
    lines = pages.select("document_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.withColumn("next", F.lead("line").over(Window.partitionBy("document_id", "page").orderBy("pos"))).filter("length(line) >= 20")
    goes_on = (F.length(F.coalesce("next", F.lit(""))) >= 20) & ~F.col("line").endswith(".") & ~F.col("line").contains(":")
    kinds = F.array(
        F.struct(F.lit("single_line").alias("category"), F.lit(True).alias("fits")),
        F.struct(F.lit("multi_line").alias("category"), goes_on.alias("fits")),
        F.struct(F.lit("numeric").alias("category"), F.col("line").rlike("[0-9]").alias("fits")),
        F.struct(F.lit("hyphenated").alias("category"), F.col("line").rlike("[a-zA-Z]{2,}-[a-zA-Z]{2,}").alias("fits")),
        F.struct(F.lit("typographic").alias("category"), F.col("line").rlike(f"[{X.DOUBLE_QUOTES}{X.SINGLE_QUOTES}{X.DASHES}]").alias("fits")),
    )
    rows = lines.select("document_id", "page", "pos", "line", "next", F.explode(kinds).alias("k")).filter("k.fits")
    quote = F.when(F.col("category") == "multi_line", F.concat_ws(" ", "line", "next")).otherwise(F.col("line"))
    first = F.row_number().over(Window.partitionBy("document_id", "page", "k.category").orderBy("pos"))
    return rows.withColumn("n", first).filter("n = 1").select("document_id", "page", "k.category", "line", "next").select("document_id", "page", "category", quote.alias("quote"))
