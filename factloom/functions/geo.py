"""Coordinates as columns: STRUCT<lng, lat> values and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Web Mercator sphere and latitude limit, archive limits, shapefile members.
RADIUS = 6378137.0
MOST_LATITUDE = 85.05112878
SHAPEFILE_MEMBERS = (".shp", ".shx", ".dbf")
MAX_ARCHIVE_FILES, MAX_ARCHIVE_RATIO = 200, 50


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def from_mercator(x: Column, y: Column) -> Column:
    """Web Mercator metres as degrees with six decimals, the latitude held within the projection's limit."""
    lng = F.degrees(x / RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.pi() / 2)
    return _point(F.round(lng, 6), F.round(F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), lat)), 6))


def normalized(lng: Column, lat: Column) -> Column:
    """A coordinate in degrees; pairs out of range are taken for Web Mercator metres."""
    metres = (F.abs(lng) > 180) | (F.abs(lat) > 90)
    return F.when(metres, from_mercator(lng, lat)).otherwise(_point(lng, lat))


def bbox(points: Column) -> Column:
    """STRUCT<west, south, east, north> of an array of points; zeros for an empty one."""
    side = lambda f, k: F.coalesce(f(F.transform(points, lambda p: p[k])), F.lit(0.0))
    return F.struct(side(F.array_min, "lng").alias("west"), side(F.array_min, "lat").alias("south"), side(F.array_max, "lng").alias("east"), side(F.array_max, "lat").alias("north"))


def centroid(points: Column) -> Column:
    """The mean of an array of points without the closing one of a ring, with six decimals; zero for an empty one."""
    n = F.size(points)
    closed = (n > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    own = F.when(n > 0, F.slice(points, 1, F.when(closed, n - 1).otherwise(n))).otherwise(points)
    mean = lambda k: F.round(F.coalesce(F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, p: s + p[k]), F.size(own)), F.lit(0.0)), 6)
    return _point(mean("lng"), mean("lat"))


def svg_path(points: Column, box: Column, width: float, height: float, padding: float = 0.0, closed: bool = True) -> Column:
    """Points as an SVG path scaled into a box, north up, two decimals."""
    span_x = F.greatest(box["east"] - box["west"], F.lit(1e-9))
    span_y = F.greatest(box["north"] - box["south"], F.lit(1e-9))
    x = lambda p: F.format_string("%.2f", padding + (p["lng"] - box["west"]) / span_x * (width - 2 * padding))
    y = lambda p: F.format_string("%.2f", padding + (box["north"] - p["lat"]) / span_y * (height - 2 * padding))
    steps = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), x(p), F.lit(" "), y(p)))
    return F.concat(F.array_join(steps, " "), F.lit(" Z" if closed else ""))


def equal_classes(value: Column, low: Column, high: Column, classes: int = 6, flat: int = 2) -> Column:
    """The equal-width class of a value from 0; `flat` where all values are equal."""
    at = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * classes)
    return F.when(high == low, flat).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(classes - 1))).cast("int")


def archive_faults(files: Column, packed: Column, unpacked: Column) -> Column:
    """Why an archive of `files` members is unsafe: an array of codes, empty for a safe one."""
    tests = [F.when(files > MAX_ARCHIVE_FILES, "TOO_MANY_FILES"), F.when(packed <= 0, "EMPTY"), F.when((packed > 0) & (unpacked > packed * MAX_ARCHIVE_RATIO), "RATIO")]
    return F.filter(F.array(*tests), lambda t: t.isNotNull())


def missing_members(names: Column) -> Column:
    """The members that a shapefile needs and an archive lacks."""
    own = F.transform(names, lambda n: F.regexp_extract(F.lower(n), r"(\.[a-z]+)$", 1))
    return F.array_except(F.array(*[F.lit(m) for m in SHAPEFILE_MEMBERS]), own)
