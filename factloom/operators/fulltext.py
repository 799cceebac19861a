"""Full-text search with stemming, positions and cover-density ranking, by scanning or through a stored index.

Words are runs of letters and digits in lower case, numbered from 1; stop words keep their number and are not
indexed, other words are indexed by their English stem. A query matches a text in one of two ways, as the search
contract has it: by any of its alphabetic words of more than two letters, or by all of its words.

A cover is a shortest stretch of words that satisfies the query. A text's rank is the sum over its covers of
0.1 / (1 + words in the cover that are none of the query's), so with any-matching each occurrence counts 0.1.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.stemming import EXCEPTIONS, STOP_WORDS, with_stems
from factloom.session import bound_batches

# Fixed values of the search contract: the weight of a word, the length from which a word is a keyword, the results shown.
WEIGHT, KEYWORD_LENGTH, TOP = 0.1, 3, 8
#: Folders of an index, and the texts whose occurrences of a word share a row.
PARTS, BLOCK = 64, 4096
#: Queries of a stem that share a row when many queries are asked.
QUERIES = 1024
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Terms:
    """The stems that a query looks for: any of `some`, or all of `every`."""

    some: tuple[str, ...]
    every: tuple[str, ...]
    has_keywords: bool

    @property
    def ranked(self) -> tuple[str, ...]:
        """The stems that count for the rank: the keywords, or all words if the query has no keyword."""
        return self.some if self.has_keywords else self.every


def query_terms(spark: SparkSession, text: str) -> Terms:
    """A query's stems, without stop words. Only its own words are stemmed here."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
    keywords = {w for w in words if len(w) >= KEYWORD_LENGTH and re.fullmatch("[a-z]+", w)}
    wanted = sorted(set(words) - set(STOP_WORDS))
    rows = with_stems(spark.createDataFrame([(w,) for w in wanted], "word string")).collect() if wanted else []
    stem = {r["word"]: r["stem"] for r in rows}
    pick = lambda some: tuple(sorted({stem[w] for w in some if w in stem}))
    return Terms(pick(keywords), pick(wanted), bool(keywords))


def occurrences(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, positions) of every word that is no stop word, in order of place. A text's words are grouped where it is
    read, so nothing is shuffled; texts that share a key keep their own rows."""
    bound_batches(chunks.sparkSession)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    kind = chunks.schema[key].dataType.simpleString()
    each = chunks.select(F.col(key).alias("key"), words.alias("words")).mapInArrow(_grouped, f"key {kind}, word string, positions array<int>")
    return each.filter(~F.col("word").isin(*STOP_WORDS)).withColumnRenamed("key", key)


def _grouped(batches, most: int = 1 << 20):
    """The words of each row with their places, about `most` places a batch."""
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy())
        lo = 0
        while lo < len(b):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 4096]), most, "right")))
            keys, words = b.column(0).slice(lo, n), b.column(1).slice(lo, n)
            lo += n
            coded = words.flatten().dictionary_encode()
            code, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            at = np.arange(len(code)) - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])[row] + 1
            order = np.lexsort((at, code, row))
            code, row, at = code[order], row[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.array([], dtype=np.int64)
            ends = np.concatenate([first, [len(code)]]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[first])), coded.dictionary.take(pa.array(code[first])), positions], names=["key", "word", "positions"])


def _vocabulary(found: DataFrame) -> DataFrame:
    return with_stems(found.select("word").distinct())


def scan_hits(chunks: DataFrame, terms: Terms, key: str, text: str = "text") -> DataFrame:
    """(key, stem, positions) of the query's stems by reading all texts: each distinct word is stemmed once, and only
    words of a wanted stem are looked for."""
    wanted = sorted({*terms.some, *terms.every})
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    kinds = chunks.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
    # stemming leaves the first two letters alone, or the first where only that is left, but for the listed exceptions
    near = F.col("word").isin(*EXCEPTIONS) | F.substring("word", 1, 2).isin(*{t[:2] for t in wanted}) | F.substring("word", 1, 1).isin(*{t for t in wanted if len(t) == 1})
    spelled = with_stems(kinds.filter(~F.col("word").isin(*STOP_WORDS) & near)).filter(F.col("stem").isin(*wanted))
    each = chunks.select(key, F.posexplode(words).alias("at", "word"))
    met = each.join(spelled, "word")  # a few spellings a stem: Spark broadcasts them if their size allows
    return met.groupBy(key, "stem").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


def ranked_hits(hits: DataFrame, terms: Terms, key: str) -> DataFrame:
    """(key, rank) of the texts that a query matches, from (key, stem, positions) of its stems."""
    wanted = sorted({*terms.some, *terms.every})
    numbered = F.array_position(F.array(*[F.lit(t) for t in wanted]), F.col("stem")).cast("int") - 1
    places = F.transform("positions", lambda p: F.struct(p.cast("int").alias("at"), F.col("n").alias("n")))
    texts = hits.withColumn("n", numbered).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(places))).alias("hits"), F.collect_set("stem").alias("stems"))  # of one text
    some, every = (F.array(*[F.lit(t) for t in x]).cast("array<string>") for x in (terms.some, terms.every))
    all_of = F.size(F.array_intersect("stems", every)) == len(terms.every) if terms.every else F.lit(False)
    texts = texts.filter(F.arrays_overlap("stems", some) | all_of) if terms.some else texts.filter(all_of)
    ranked = [wanted.index(t) for t in terms.ranked]
    if not ranked:  # keywords that are all stop words: matched by the other words, ranked by none
        return texts.select(key, F.lit(0.0).alias("rank"))
    own = F.filter("hits", lambda h: h["n"].isin(*ranked))
    rank = F.size(own) * F.lit(WEIGHT) if terms.has_keywords else _covers(own, ranked)
    return texts.select(key, rank.cast("double").alias("rank"))


def _covers(hits: Column, numbers: list[int]) -> Column:
    """The summed weight of the shortest stretches that hold all the numbers, over hits (at, n) in order of place.

    One pass keeps the last place of each number: a hit ends a cover if the earliest of them has moved on. A cover's
    other words are its width less its hits; the hit's index is carried for that.
    """
    last = F.array_repeat(F.lit(None).cast("struct<at:int,i:int>"), len(numbers))
    start = F.struct(last.alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("from"), F.lit(0.0).alias("sum"))

    def step(acc: Column, h: Column) -> Column:
        own = F.array_position(F.array(*[F.lit(n) for n in numbers]), h["n"]) - 1
        last = F.transform(acc["last"], lambda x, j: F.when(j == own, F.struct(h["at"].alias("at"), acc["i"].alias("i"))).otherwise(x))
        first = F.array_min(last)
        whole = F.forall(last, lambda x: x.isNotNull()) & (first["i"] > acc["from"])
        noise = h["at"] - first["at"] - (acc["i"] - first["i"])
        return F.struct(last.alias("last"), (acc["i"] + 1).alias("i"), F.when(whole, first["i"]).otherwise(acc["from"]).alias("from"), (acc["sum"] + F.when(whole, WEIGHT / (1.0 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(hits, start, step, lambda acc: acc["sum"])


def search(chunks: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """(key, rank) of every text that the query matches, by reading all texts."""
    terms = query_terms(chunks.sparkSession, query)
    return ranked_hits(scan_hits(chunks, terms, key, text), terms, key)


def best(ranked: DataFrame, key: str, top: int = TOP) -> DataFrame:
    return ranked.orderBy(F.desc("rank"), key).limit(top)


# ---- the stored index


def _part(stem: Column, parts: int) -> Column:
    return F.pmod(F.crc32(stem.cast("binary")), F.lit(parts)).cast("int")


def write_index(chunks: DataFrame, path: str, key: str, text: str = "text", parts: int = PARTS, block: int = BLOCK) -> None:
    """Writes the postings of all texts as Parquet under `path`: (part, stem, block, postings), where postings are
    (key, positions) in order of key.

    A stem's part is a hash of it, a folder of its own, and within a part rows are in order of stem, so a reader
    opens its words' folders and skips the row groups of others. A stem's texts are dealt to blocks of about `block`
    by a hash of their key, so no row grows with the corpus and a word of every text is written by many tasks.
    """
    found = occurrences(chunks, key, text)
    texts = chunks.count()
    blocks = max(1, -(-texts // block))
    rows = found.join(_vocabulary(found), "word").select(key, "stem", "positions", F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    files = max(1, -(-blocks // 256))  # of a part
    rows = rows.withColumns({"part": _part(F.col("stem"), parts), "file": F.pmod("block", F.lit(files))}).repartition("part", "file")
    own = F.struct(F.col(key).alias("key"), "positions")
    lists = rows.groupBy("part", "file", "stem", "block").agg(F.array_sort(F.collect_list(own)).alias("postings"))  # in the places they were dealt to
    lists.drop("file").sortWithinPartitions("part", "stem", "block").write.partitionBy("part").parquet(f"{path}/postings")
    meta = [(parts, key, chunks.schema[key].dataType.simpleString())]
    chunks.sparkSession.createDataFrame(meta, "parts int, key string, kind string").coalesce(1).write.parquet(f"{path}/meta")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, int, str]:
    """An index's postings, its number of parts and the name of its key. The schema is given, so no file is opened for it."""
    meta = spark.read.parquet(f"{path}/meta").first()
    schema = f"stem string, block long, postings array<struct<key:{meta['kind']},positions:array<int>>>, part int"
    return spark.read.schema(schema).parquet(f"{path}/postings"), meta["parts"], meta["key"]


def index_hits(spark: SparkSession, path: str, terms: Terms) -> DataFrame:
    """(key, stem, positions) of the query's stems from an index: only the folders of its stems are read."""
    postings, parts, key = _opened(spark, path)
    wanted = sorted({*terms.some, *terms.every})
    folders = sorted({zlib.crc32(t.encode()) % parts for t in wanted})
    rows = postings.filter(F.col("part").isin(*folders) & F.col("stem").isin(*wanted))
    return rows.select("stem", F.explode("postings").alias("p")).select(F.col("p.key").alias(key), "stem", "p.positions")


def search_index(spark: SparkSession, path: str, query: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, rank) of every text that the query matches, through an index; `keys` (one column, the key) restricts the
    search, as to the texts of one document."""
    terms = query_terms(spark, query)
    hits = index_hits(spark, path, terms)
    key = hits.columns[0]
    return ranked_hits(hits if keys is None else hits.join(keys, key, "left_semi"), terms, key)


def search_many(spark: SparkSession, path: str, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, key, rank, place): the best texts by any-matching for a table of queries (query_id, text).

    Queries meet the postings on (part, stem); Spark prunes the folders by the queries' parts at run time. A text is in one
    block, so each block's ranks are summed and cut to the best where the block was dealt, and only those are shuffled; the
    queries of a stem are dealt to lists of about QUERIES.
    """
    postings, parts, key = _opened(spark, path)
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))), lambda w: w.rlike("^[a-z]{3,}$"))
    asked = queries.select("query_id", F.explode(words).alias("word")).filter(~F.col("word").isin(*STOP_WORDS))
    asked = asked.join(with_stems(asked.select("word").distinct()), "word").select("query_id", "stem", _part(F.col("stem"), parts).alias("part")).distinct()
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERIES))))
    asked = asked.groupBy("part", "stem", dealt.alias("dealt")).agg(F.collect_list("query_id").alias("queries"))
    counts = F.transform("postings", lambda p: F.struct(p["key"].alias("key"), F.size(p["positions"]).alias("n")))
    met = postings.join(asked, ["part", "stem"]).select("block", "queries", counts.alias("texts")).repartition("block")
    each = met.select("block", F.explode("queries").alias("query_id"), "texts").select("block", "query_id", F.inline("texts"))
    ranks = each.groupBy("block", "query_id", F.col("key").alias(key)).agg((F.sum("n") * F.lit(WEIGHT)).alias("rank")).drop("block")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), key))
    return ranks.withColumn("place", place).filter(F.col("place") <= top)
