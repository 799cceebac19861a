"""CSV and TSV files as tables of text columns, typed on request, and safe export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.tabular import check_limits, coerce, infer_types, safe_cell


def read_table(spark: SparkSession, path: str, typed: bool = True, limits: bool = True) -> DataFrame:
    """A delimited file with a header: blank lines dropped, cells trimmed, short rows padded with null, surplus cells
    dropped, repeated headers numbered. A tab separates in `.tsv` files. Typed tables hold numbers as DOUBLE."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    raw = reader.option("escape", '"').option("sep", "\t" if path.lower().endswith(".tsv") else ",").csv(path)
    if limits:
        raw = check_limits(raw)
    if not typed:
        return raw
    types = {r["column"]: r["inferred_type"] for r in infer_types(raw).collect()}  # one row a column
    return coerce(raw, types).select(*raw.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV whose cells no spreadsheet takes for formulas."""
    safe = df.select(*[safe_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    safe.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_versions(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows appended as Parquet; updates are newer versions of a key, read back with `latest`."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def result_hash(df: DataFrame, key: str) -> DataFrame:
    """(key, digest): SHA-256 of each key's rows as JSON in sorted order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*rest)))), "\n"), 256).alias("digest"))
