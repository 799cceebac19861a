"""Place names against a gazetteer: exact, ambiguous or not found, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X


_ASKED = ("key", "parent", "country")


def candidates(records: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """key, parent, country and place_id: the places left for each question of the records (record_id, name, parent, country).
    Records that ask the same are one question, so a common name meets its places once a parent and country, not once a record."""
    names = gazetteer.select("place_id", "parent_code", "country_code", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("known"))
    names = names.select(X.place_key(F.col("known")).alias("key"), "place_id", "parent_code", "country_code").filter("key <> ''")
    met = records.select(X.place_key(F.col("name")).alias("key"), "parent", "country").distinct().join(names, "key")
    w = Window.partitionBy(*_ASKED)
    parent = F.coalesce((F.col("parent_code") == F.col("parent")) | (F.col("place_id") == F.col("parent")), F.lit(False))
    met = met.withColumn("by_parent", parent).withColumn("any_parent", F.max("by_parent").over(w)).filter("by_parent or not any_parent")
    met = met.withColumn("by_country", F.coalesce(F.col("country_code") == F.col("country"), F.lit(False))).withColumn("any_country", F.max("by_country").over(w)).filter("by_country or not any_country")
    return met.select(*_ASKED, "place_id")


def lookup_places(records: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """record_id, status, n and place_id (of the one match) of records (record_id, name, parent, country).

    `gazetteer` is (place_id, name, parent_code, country_code, aliases). Names meet by normal form or alias in an
    equi-join; parent and country narrow the candidates only where some agree.
    """
    found = candidates(records, gazetteer).groupBy(*[F.col(c).alias(f"_{c}") for c in _ASKED]).agg(F.count_distinct("place_id").alias("n"), F.min("place_id").alias("first"))
    asked = records.select("record_id", X.place_key(F.col("name")).alias("key"), "parent", "country")
    status = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    same = (F.col("key") == F.col("_key")) & F.col("parent").eqNullSafe(F.col("_parent")) & F.col("country").eqNullSafe(F.col("_country"))
    return asked.join(found, same, "left").select("record_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("first")).alias("place_id"))


_PARTS = (("matched", "exact"), ("ambiguous", "ambiguous"), ("unmatched", "not_found"))


def partition_places(looked_up: DataFrame) -> dict[str, DataFrame]:
    """matched, ambiguous and unmatched records."""
    return {k: looked_up.filter(F.col("status") == s) for k, s in _PARTS}


def partition_sizes(looked_up: DataFrame) -> DataFrame:
    """part and n of the parts that hold records, from one pass over them."""
    part = F.create_map(*[F.lit(x) for k, s in _PARTS for x in (s, k)])[F.col("status")]
    return looked_up.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def boundaries(gazetteer: DataFrame, level: str | None = None, place_id: str | None = None) -> DataFrame:
    """Gazetteer entries of a level, or the one of an id in any case."""
    if place_id is not None:
        return gazetteer.filter(F.lower("place_id") == place_id.lower())
    return gazetteer.filter(F.col("level") == level) if level else gazetteer


def decode_arcs(points: DataFrame) -> DataFrame:
    """arc, pos, x and y of delta-coded arc points (arc, pos, dx, dy, scale_x, scale_y, move_x, move_y)."""
    w = Window.partitionBy("arc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return points.select("arc", "pos", (F.sum("dx").over(w) * F.col("scale_x") + F.col("move_x")).alias("x"), (F.sum("dy").over(w) * F.col("scale_y") + F.col("move_y")).alias("y"))
