"""GeoJSON, KML, GPX and TopoJSON texts as rows of features. Built-in functions only.

Every reader takes (file_id, text) and gives file_id, seq, feature_id, geom_type, props (MAP) and points
(ARRAY<STRUCT<lng, lat>>), altitude dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.geo import normalized

# Geometry and file types, feature limit, place-like property names.
GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
FILE_TYPES = (*GEOMETRIES, "Feature", "FeatureCollection")
MAX_FEATURES = 50_000
PLACE_NAMES = ("name", "district", "state", "ward", "city", "region", "place")
_PAIR = r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)(?:\s*,\s*-?[0-9.eE+-]+)?\s*\]"


def _points(pairs: Column, separator: str = r"\s*,\s*") -> Column:
    """Texts 'lng,lat[,alt]' as normalized points; malformed ones are dropped."""
    made = F.transform(pairs, lambda p: normalized(F.split(p, separator)[0].try_cast("double"), F.try_element_at(F.split(p, separator), F.lit(2)).try_cast("double")))
    return F.filter(made, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())


def geojson_faults(files: DataFrame, most: int = MAX_FEATURES) -> DataFrame:
    """file_id and code: INVALID_GEOMETRY for an unknown type or broken JSON, GEO_FEATURE_LIMIT_EXCEEDED for too many features; null if sound."""
    kind = F.get_json_object("text", "$.type")
    size = F.coalesce(F.size(F.from_json(F.get_json_object("text", "$.features"), "array<string>")), F.lit(0))
    code = F.when(kind.isNull() | ~kind.isin(*FILE_TYPES), "INVALID_GEOMETRY").when(size > most, "GEO_FEATURE_LIMIT_EXCEEDED")
    return files.select("file_id", code.alias("code"))


def read_geojson(files: DataFrame) -> DataFrame:
    kind = F.get_json_object("text", "$.type")
    several = F.from_json(F.get_json_object("text", "$.features"), "array<string>")
    one = F.when(kind == "Feature", F.array("text")).when(kind.isin(*GEOMETRIES), F.array(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("text"), F.lit("}"))))
    rows = files.select("file_id", F.posexplode(F.when(kind == "FeatureCollection", several).otherwise(one)).alias("seq", "feature"))
    own = F.get_json_object("feature", "$.id")
    pairs = F.regexp_extract_all(F.get_json_object("feature", "$.geometry.coordinates"), F.lit(_PAIR), 1)
    single = F.array(F.regexp_extract(F.get_json_object("feature", "$.geometry.coordinates"), r"^\[\s*(.*?)\s*\]$", 1))
    geometry = F.get_json_object("feature", "$.geometry.type")
    return rows.select(
        "file_id",
        "seq",
        F.coalesce(own, F.concat(F.lit("feat_"), (F.col("seq") + 1).cast("string"))).alias("feature_id"),
        geometry.alias("geom_type"),
        F.coalesce(F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("props"),
        _points(F.when(geometry == "Point", single).otherwise(pairs)).alias("points"),
    )


def read_kml(files: DataFrame) -> DataFrame:
    """Placemarks: name, description, extended data, and the first number of the description as `value`; one point is
    a Point, a closed ring of four or more a Polygon, else a LineString."""
    rows = files.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)(<Placemark.*?</Placemark>)"), 1)).alias("seq", "p"))
    inner = lambda tag: F.trim(F.regexp_extract("p", rf"(?is)<{tag}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))
    points = _points(F.filter(F.split(inner("coordinates"), r"\s+"), lambda s: F.length(s) > 0))
    rows = rows.select("file_id", "seq", "p", inner("name").alias("name"), inner("description").alias("description"), points.alias("points"))
    keys = lambda g: F.concat(
        F.regexp_extract_all("p", F.lit(r'(?is)<Data\s+name="([^"]*)"\s*>\s*<value>(.*?)</value>'), g),
        F.regexp_extract_all("p", F.lit(r'(?is)<SimpleData\s+name="([^"]*)"\s*>(.*?)</SimpleData>'), g),
    )
    number = F.regexp_extract("description", r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    base = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description"), F.lit("value"), F.replace(number, F.lit(","), F.lit(""))), lambda k, v: F.length(v) > 0)
    extra = F.map_filter(F.map_from_arrays(F.array_distinct(keys(1)), F.slice(keys(2), 1, F.size(F.array_distinct(keys(1))))), lambda k, v: ~k.isin("name", "description", "value"))
    n = F.size("points")
    ring = (n >= 4) & (F.try_element_at("points", F.lit(1)) == F.try_element_at("points", F.lit(-1)))
    kind = F.when(n == 1, "Point").when(ring, "Polygon").when(n >= 2, "LineString")
    return rows.select("file_id", "seq", F.concat(F.lit("feat_"), (F.col("seq") + 1).cast("string")).alias("feature_id"), kind.alias("geom_type"), F.map_concat(base, extra).alias("props"), "points").filter("geom_type is not null")


def read_gpx(files: DataFrame) -> DataFrame:
    """Waypoints and track points, attributes in either order, with name and elevation."""
    rows = files.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)(<(?:wpt|trkpt)\b.*?(?:/>|</(?:wpt|trkpt)>))"), 1)).alias("seq", "p"))
    number = lambda a: F.regexp_extract("p", rf'(?i)\b{a}="(-?[0-9.]+)"', 1).try_cast("double")
    inner = lambda tag: F.trim(F.regexp_extract("p", rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    props = F.map_filter(F.create_map(F.lit("name"), inner("name"), F.lit("elevation"), inner("ele")), lambda k, v: F.length(v) > 0)
    return rows.select("file_id", "seq", F.concat(F.lit("feat_"), (F.col("seq") + 1).cast("string")).alias("feature_id"), F.lit("Point").alias("geom_type"), props.alias("props"), F.array(normalized(number("lon"), number("lat"))).alias("points"))


def read_topojson(files: DataFrame) -> DataFrame:
    """Polygons of every object's geometries, their delta-coded arcs decoded and joined; a negative index is an arc reversed."""
    kind = "struct<scale:array<double>,translate:array<double>>"
    base = files.select(
        "file_id",
        F.from_json(F.get_json_object("text", "$.transform"), kind).alias("t"),
        F.from_json(F.get_json_object("text", "$.arcs"), "array<array<array<double>>>").alias("arcs"),
        F.from_json(F.get_json_object("text", "$.objects"), "map<string,string>").alias("objects"),
    )
    step = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def walk(acc: Column, d: Column) -> Column:
        x, y = acc["x"] + d[0], acc["y"] + d[1]
        return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), y.alias("y")))).alias("out"))

    scale = lambda i: F.coalesce(F.col("t.scale")[i], F.lit(1.0))
    move = lambda i: F.coalesce(F.col("t.translate")[i], F.lit(0.0))
    plain = F.transform("arcs", lambda a: F.transform(a, lambda d: normalized(d[0], d[1])))
    decoded = F.transform("arcs", lambda a: F.transform(F.aggregate(a, step, walk)["out"], lambda p: normalized(p["x"] * scale(0) + move(0), p["y"] * scale(1) + move(1))))
    base = base.withColumn("arcs", F.when(F.col("t").isNull(), plain).otherwise(decoded))
    objects = base.select("file_id", "arcs", F.explode("objects").alias("name", "o"))
    shapes = F.coalesce(F.from_json(F.get_json_object("o", "$.geometries"), "array<string>"), F.array("o"))
    rows = objects.select("file_id", "arcs", "name", F.posexplode(shapes).alias("at", "g")).filter(F.get_json_object("g", "$.type") == "Polygon")
    ring = F.from_json(F.get_json_object("g", "$.arcs[0]"), "array<int>")
    part = lambda i: F.when(i >= 0, F.element_at("arcs", F.greatest(i, F.lit(0)) + 1)).otherwise(F.reverse(F.element_at("arcs", F.greatest(-i - 1, F.lit(0)) + 1)))
    points = F.aggregate(ring, F.array().cast("array<struct<lng:double,lat:double>>"), lambda s, i: F.concat(s, F.slice(part(i), F.when(F.size(s) > 0, 2).otherwise(1), F.size(part(i)))))
    seq = F.row_number().over(Window.partitionBy("file_id").orderBy("name", "at")) - 1
    return rows.select(
        "file_id",
        seq.alias("seq"),
        F.coalesce(F.get_json_object("g", "$.id"), F.concat(F.lit("feat_"), (seq + 1).cast("string"))).alias("feature_id"),
        F.lit("Polygon").alias("geom_type"),
        F.coalesce(F.from_json(F.get_json_object("g", "$.properties"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("props"),
        points.alias("points"),
    )


def read_geo(files: DataFrame) -> DataFrame:
    """Files of any of the four kinds, told apart by their text."""
    start = F.lower(F.substring("text", 1, 2000))
    tests = {"kml": start.contains("<kml"), "gpx": start.contains("<gpx"), "topojson": start.rlike('"type"\\s*:\\s*"topology"')}
    kind = F.when(tests["kml"], "kml").when(tests["gpx"], "gpx").when(tests["topojson"], "topojson").otherwise("geojson")
    marked = files.withColumn("kind", kind)
    parts = [reader(marked.filter(F.col("kind") == k).drop("kind")) for k, reader in (("geojson", read_geojson), ("kml", read_kml), ("gpx", read_gpx), ("topojson", read_topojson))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def measures(features: DataFrame) -> DataFrame:
    """file_id, feature_id, name and value: the numeric properties of features."""
    props = features.select("file_id", "feature_id", F.explode("props").alias("name", "text"))
    return props.select("file_id", "feature_id", "name", F.col("text").try_cast("double").alias("value")).filter("value is not null")


def place_mentions(features: DataFrame) -> DataFrame:
    """file_id, feature_id and name: the place-like properties of features, for the gazetteer."""
    props = features.select("file_id", "feature_id", F.explode("props").alias("key", "name"))
    return props.filter(F.lower("key").isin(*PLACE_NAMES) & (F.length("name") > 0)).select("file_id", "feature_id", "name")
