"""Files as a DataFrame: kind, hash, image header and limits, from the `binaryFile` reader's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File signatures (hex), extensions and limits.
SIGNATURES = (("pdf", 1, "25504446"), ("png", 1, "89504E470D0A1A0A"), ("jpeg", 1, "FFD8FF"), ("tiff", 1, "49492A00"), ("tiff", 1, "4D4D002A"), ("webp", 9, "57454250"))
EXTENSIONS = {
    "csv": ("csv", "tsv"), "geojson": ("geojson",), "kml": ("kml",), "gpx": ("gpx",), "topojson": ("topojson",),
    "pdf": ("pdf",), "png": ("png",), "jpeg": ("jpg", "jpeg"), "tiff": ("tif", "tiff"), "webp": ("webp",),
}
MODALITIES = {"table": ("csv",), "geo": ("geojson", "kml", "gpx", "topojson"), "image": ("png", "jpeg", "tiff", "webp"), "document": ("pdf",)}
UNSUPPORTED = "UNSUPPORTED_FORMAT"
DEFAULT_SIZE = (1920, 1080)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and length of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def file_kind(content: Column, name: Column) -> Column:
    """The kind of a file: tables and geodata by extension, then images and PDF by signature or extension."""
    extension = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    signed = lambda kind: [F.hex(F.substring(content, at, len(h) // 2)) == h for k, at, h in SIGNATURES if k == kind]
    out = F
    for kind in ("csv", "geojson", "kml", "gpx", "topojson", "png", "jpeg", "tiff", "webp", "pdf"):
        test = extension.isin(*EXTENSIONS[kind])
        for s in signed(kind):
            test |= F.coalesce(s, F.lit(False))
        out = out.when(test, kind)
    return out.otherwise(UNSUPPORTED)


def modality(kind: Column) -> Column:
    out = F
    for name, kinds in MODALITIES.items():
        out = out.when(kind.isin(*kinds), name)
    return out


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def image_size(content: Column, kind: Column) -> Column:
    """STRUCT(width, height): from a PNG's header, else the default."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    png = kind == "png"
    return F.struct(F.when(png, number(17)).otherwise(DEFAULT_SIZE[0]).alias("width"), F.when(png, number(21)).otherwise(DEFAULT_SIZE[1]).alias("height"))
