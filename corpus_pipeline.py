"""A training-data pipeline over `documents`: each stage reads the documents that the one before it wrote.

Decisions are made by row, that is by id and text: rows that share an id and differ in text are judged apart, and of
rows that repeat both, the exact stage leaves one. A null id is an id of its own kind: such rows are judged like
others, and one of a group stays where no row with an id does. Extra columns of documents pass through every stage
but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import KeyFilter, fresh_dir, free_name, text_of, without_keys, written
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import draw
from factloom.llm.quality import quality_scores
from factloom.llm.queries import vocabulary
from factloom.llm.sentencepiece_scan import encode_and_check
from factloom.session import table


#: Bytes of an Arrow batch of texts within the stages, whose executors hold two Python workers and the JVM's share.
STAGE_BATCH_BYTES = 2 << 20


def _row(id_col: Column, text_sha: Column) -> Column:
    """What a decision is about: a document's id and text, as one key."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), text_sha)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their row key, and its name, which no other column has."""
    name = free_name(docs, "row_key")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STAGE_BATCH_BYTES))
    return docs.withColumn(name, _row(F.col("doc_id"), F.sha2(text_of(), 256))), name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score at least 0.7)."""
    keyed, name = _keyed(docs)
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), with_sha=True)
    rejected = scores.filter("predicted = 0").select(_row(F.col("doc_id"), F.col("text_sha256")).alias(name)).distinct()
    return without_keys(keyed, rejected, name).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of equal texts."""
    keyed, name = _keyed(docs)
    decided = written(exact_dedup(docs).select(_row(F.col("doc_id"), F.col("text_sha256")).alias(name), "kept"), "decided")
    kept = without_keys(keyed, decided.filter("not kept").select(name).distinct(), name)
    repeated = written(decided.filter("kept").groupBy(name).count().filter("count > 1").select(name), "repeated")  # rows that repeat id and text
    if not repeated.isEmpty():
        again = kept.filter(KeyFilter(repeated, name).may_contain(F.col(name))).join(repeated, name, "left_semi")
        kept = without_keys(kept, repeated, name).unionByName(again.dropDuplicates([name]))
    return kept.drop(name)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest id, where ids
    are unique. Rows whose id is null or another row's too are numbered for this stage by 62 bits of their row key's
    SHA-256, below all other ids."""
    keyed, name = _keyed(docs)
    number = free_name(keyed, "row_number")
    shared = keyed.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    few = written(shared, "shared")
    own = -1 - F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)") % (1 << 62)
    if few.isEmpty():
        numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    else:
        odd = keyed.join(few, keyed["doc_id"].eqNullSafe(few["doc_id"]), "left_semi").withColumn(number, own.cast("long"))
        rest = keyed.join(few, keyed["doc_id"].eqNullSafe(few["doc_id"]), "left_anti").withColumn(number, F.col("doc_id").cast("long"))
        numbered = rest.unionByName(odd).drop(name)
    rejected = near_duplicates(numbered, k=5, percent=80, id_col=number).filter("not kept").select(number).distinct()
    return without_keys(numbered, rejected, number).drop(number)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their flattened shares."""
    return draw(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document, their digest, and whether decoding gave the text back.
    Workers keep no vocabulary between tasks, as they live on beside those of the other stages."""
    return encode_and_check(docs, vocabulary("piece_bpe_32k.model"), keep_ids=True, lean=True)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
