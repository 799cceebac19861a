"""What the document views show: counts, filters, listings, the image guard, the audit dossier, and the ingest job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import layout as L
from factloom.operators import search as S
from factloom.operators import verify as V
from factloom.streaming import events as E

# Fixed values of the views.
PROOFS = ("VERIFIED", "VERIFIED_OCR", "COMPUTED", "DERIVED", "USER_CONFIRMED", "ESTIMATED")
MOST_CANDIDATES, MOST_SHOWN = 10, 6
IMAGE_BYTES, IMAGE_SIDE = 25 * 1024 * 1024, 8000
IMAGE_SIGNATURES = (("image/png", "^89504E47.{8}"), ("image/jpeg", "^FFD8FF"), ("image/webp", "^52494646.{8}57454250"), ("image/tiff", "^(49492A00|4D4D002A)"))
PASSING_PRECISION, PASSING_GROUNDING = 0.99, 1.0
GRAM_WEIGHT, UNSEEN_IDF = 0.4, 2.0
COMPUTED_KINDS = ("csv", "geo")
LISTINGS = {"documents": (("created_at", False),), "facts": (("page", True), ("fact_id", True)), "chunks": (("page", True), ("chunk_index", True)), "events": (("sequence", True),)}


def viewer_counts(facts: DataFrame) -> DataFrame:
    """document_id, verified, failed (with a reason), unverified (the rest) and pages (those with facts) of each document."""
    ok, no = F.col("verified"), ~F.col("verified") & (F.coalesce("fail_reason", F.lit("")) != "")
    return facts.groupBy("document_id").agg(
        F.count_if(ok).alias("verified"), F.count_if(no).alias("failed"), F.count_if(~ok & ~no).alias("unverified"), F.count_distinct("page").alias("pages")
    )


def page_histogram(facts: DataFrame) -> DataFrame:
    """document_id, page, facts and verified of each page that has facts."""
    return facts.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("facts"), F.count_if("verified").alias("verified"))


def proof_counts(facts: DataFrame) -> DataFrame:
    """document_id, proof and n: a row for every proof of the filter bar, 0 where a document has none."""
    counts = [F.struct(F.lit(p).alias("proof"), F.count_if(F.col("proof_type") == p).alias("n")) for p in PROOFS]
    return facts.groupBy("document_id").agg(F.array(*counts).alias("c")).select("document_id", F.inline("c"))


def in_category(facts: DataFrame, category: str | None) -> DataFrame:
    """Facts whose label holds the category in any case, or whose type is it; all for none."""
    if not category:
        return facts
    return facts.filter(F.contains(F.lower("label"), F.lit(category.lower())) | (F.col("type") == category))


def search_glossary(terms: DataFrame, text: str = "") -> DataFrame:
    """Terms whose name or definition holds the text in any case."""
    return terms.filter(F.contains(F.lower("term"), F.lit(text.lower())) | F.contains(F.lower("definition"), F.lit(text.lower())))


def split_reviews(items: DataFrame) -> dict[str, DataFrame]:
    """Review items that are pending and those resolved."""
    return {"pending": items.filter("status = 'pending'"), "resolved": items.filter("status <> 'pending'")}


def split_page_facts(routed: DataFrame) -> dict[str, DataFrame]:
    """Routed candidates of scanned pages: verified, for review (a candidate may be in neither), and all."""
    return {"verified": routed.filter("proof_type = 'VERIFIED_OCR'"), "review": routed.filter("needs_review"), "all": routed}


def listing(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the order of their listing: documents newest first, facts by page, chunks by place, events by sequence."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in LISTINGS[kind]])


def top_candidates(candidates: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The chart kinds of each document in rank order, `most` at most, with their points."""
    kinds = candidates.select("document_id", "kind", "rank").distinct()
    placed = kinds.groupBy("document_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("rank", "kind"))), 1, most).alias("k"))  # as many as there are kinds of chart
    return candidates.join(placed.select("document_id", F.explode("k.kind").alias("kind")), ["document_id", "kind"], "left_semi")


def modality_summary(scores: DataFrame) -> DataFrame:
    """modality, samples, passed, precision, grounding and meets of scored samples (modality, precision, grounding, passed)."""
    rows = scores.groupBy("modality").agg(F.count(F.lit(1)).alias("samples"), F.count_if("passed").alias("passed"), F.avg("precision").alias("precision"), F.avg("grounding").alias("grounding"))
    return rows.withColumn("meets", (F.col("precision") >= PASSING_PRECISION) & (F.col("grounding") >= PASSING_GROUNDING) & (F.col("passed") == F.col("samples")))


def image_guard(content: Column, size: Column, width: Column, height: Column) -> Column:
    """STRUCT(mime, reason, has_exif): reason is null for an image that may be read. Bytes are looked at, never rewritten."""
    head = F.hex(F.substring(content, 1, 12))
    mime = F
    for name, mark in IMAGE_SIGNATURES:
        mime = mime.when(head.rlike(mark), name)
    side = (width <= 0) | (height <= 0) | (width > IMAGE_SIDE) | (height > IMAGE_SIDE)
    reason = F.when(size > IMAGE_BYTES, "FILE_TOO_LARGE").when(mime.isNull(), "UNSUPPORTED_FORMAT").when(side, "IMAGE_DIMENSIONS_EXCEEDED")
    exif = F.coalesce((mime == "image/jpeg") & F.contains(F.substr(content, F.lit(1), F.length(content) - 1), F.unhex(F.lit("FFE1"))), F.lit(False))
    return F.struct(mime.alias("mime"), reason.alias("reason"), exif.alias("has_exif"))


def audit_dossier(documents: DataFrame, facts: DataFrame, reviews: DataFrame, conflicts: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id and dossier (JSON): the document's columns with its counts of facts, pending reviews, conflicts and terms."""
    count = lambda df, name, of=None: df.groupBy("document_id").agg((F.count(F.lit(1)) if of is None else F.count_if(of)).alias(name))
    out, names = documents, ["facts", "verified", "pending", "conflicts", "terms"]
    for part in (
        facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if("verified").alias("verified")),
        count(reviews, "pending", F.col("status") == "pending"), count(conflicts, "conflicts"), count(terms, "terms"),
    ):
        out = out.join(part, "document_id", "left")
    out = out.na.fill(0, names)
    return out.select("document_id", F.to_json(F.struct(*[F.col(c) for c in out.columns])).alias("dossier"))


def facts_view(facts: DataFrame, name: str = "document_facts") -> DataFrame:
    """Registers the facts under the name that older queries use, and returns the view."""
    facts.createOrReplaceTempView(name)
    return facts.sparkSession.table(name)


def money_facts(lines: DataFrame) -> DataFrame:
    """The money mentions of running lines, each with verified and stage: running headers and footers are stripped, the
    first money figure of each line is proposed and scaled, equal proposals of a page are one, and a proposal is verified
    if its quote and value stand up against the page's whole text, headers included."""
    found = L.money_mentions(L.strip_running_lines(lines))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    pages = lines.groupBy("document_id", "page").agg(text.alias("text"))  # the lines of one page
    facts = found.select("*", F.lit("money").alias("type"), F.lit(None).cast("string").alias("period"))
    checked = V.verify_facts(facts, pages, check_units=False)
    return checked.select(*[c for c in found.columns if c != "stage"], F.when(F.col("verified"), "verified").otherwise("flagged").alias("stage"), "verified", "fail_reason")


def _signed(c: Column) -> Column:
    """A whole number wrapped to signed 32 bits."""
    return F.pmod(c + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def _codes(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda ch: F.ascii(ch).cast("long"))


def tfidf_embedding(texts: DataFrame, idf: DataFrame, key: str, dim: int = 768) -> DataFrame:
    """(key, bucket, weight): the entries other than 0 of each text's unit vector. A word adds its weight to the bucket
    of its hash (times 33, the shift wrapped to 32 bits), and 0.4 of it to that of each of its trigrams (FNV, 32 bits)."""
    words = texts.select(key, F.explode(X.tokens(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    kinds = texts.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("word")).distinct().join(idf, "word", "left").withColumn("idf", F.coalesce("idf", F.lit(UNSEEN_IDF)))
    whole = F.aggregate(_codes(F.col("word")), F.lit(5381).cast("long"), lambda h, c: _signed(F.shiftleft(h, 5)) + h + c)
    fnv = lambda g: F.aggregate(_codes(g), F.lit(0x811C9DC5).cast("long"), lambda h, c: _signed(_signed(h.bitwiseXOR(c)) * F.lit(0x01000193)))
    grams = F.when(F.length("word") >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 2)), lambda i: F.substr(F.col("word"), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    entry = lambda h, w: F.struct((F.abs(h) % dim).cast("int").alias("bucket"), F.when(h.bitwiseAND(F.lit(1)) == 0, w).otherwise(-w).alias("x"))
    hashed = kinds.select("word", "idf", F.concat(F.array(entry(whole, F.lit(1.0))), F.transform(grams, lambda g: entry(fnv(g), F.lit(GRAM_WEIGHT)))).alias("e"))
    # a text's entries meet once, unspread; its sums and its norm are made where they meet
    met = words.join(hashed, "word").select(key, ((1 + F.log("n")) * F.col("idf")).alias("w"), "e").repartition(key)
    sums = met.select(key, "w", F.inline("e")).groupBy(key, "bucket").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    out = sums.withColumn("norm", norm).select(key, "bucket", F.round(F.col("x") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 6).alias("weight"))
    return out.filter("weight <> 0")


def of_document(events: DataFrame, document_id) -> DataFrame:
    """The part of a change feed, batch or stream, that belongs to one document."""
    return events.filter(F.col("document_id") == document_id)


def ingest(pages: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """The ingest job over pages (document_id, page, text) and proposed facts: chunks, facts (verified without unit checks),
    published (those verified) and events, one for each stage a document reaches. A document without text fails at extracting.
    Pages may name the `kind` of their document: tables and geodata pass no fact extraction and have no such event."""
    facts = V.verify_facts(proposals, pages, check_units=False)
    filled = F.max(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    kind = F.max("kind") if "kind" in pages.columns else F.lit(None)
    state = pages.groupBy("document_id").agg(filled.alias("ok"), kind.cast("string").alias("kind"))
    every, computed = (F.array(*[F.lit(s) for s in names]) for names in (E.STAGES, [s for s in E.STAGES if s != "fact_extraction"]))
    reached = F.when(F.col("ok"), F.when(F.col("kind").isin(*COMPUTED_KINDS), computed).otherwise(every)).otherwise(F.array(F.lit(E.STAGES[0]), F.lit(E.FAILED)))
    events = state.select("document_id", F.posexplode(reached).alias("sequence", "stage"))
    events = events.select("document_id", "sequence", "stage", E.progress_of(F.col("stage")).alias("progress"), E.status_of(F.col("stage")).alias("status"))
    with_text = pages.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return {"pages": with_text, "chunks": S.chunk_paragraphs(with_text, "\n"), "facts": facts, "published": facts.filter("verified"), "events": events}
