"""Number columns: parsing, matching and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
MOST_SUBSET_NUMBERS = 12


def parse_float_prefix(c: Column) -> Column:
    """The longest leading number of a text ('12abc' gives 12); null if there is none."""
    return F.regexp_extract(c, _PREFIX, 1).try_cast("double")


def extract_numbers(c: Column) -> Column:
    """Every number of a text, thousands commas removed, signs kept ('2026-27' gives 2026 and -27)."""
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(_NUMBER), 1), lambda s: s.cast("double"))


def close(a: Column, b: Column, tolerance: float | Column = 0.01) -> Column:
    """Whether two numbers agree within a relative tolerance of their mean size."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    mean = (F.abs(a) + F.abs(b)) / 2
    return (a == b) | F.when(mean == 0, F.abs(a - b) < 1e-6).otherwise(F.abs(a - b) <= t * mean)


def subset_sums(numbers: Column) -> Column:
    """The sums of all non-empty subsets of the first twelve numbers."""
    every = F.aggregate(F.slice(numbers, 1, MOST_SUBSET_NUMBERS), F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: s + x)))
    return F.slice(every, 2, (1 << MOST_SUBSET_NUMBERS) - 1)


def matches_subset_sum(target: Column, numbers: Column, tolerance: float | Column = 0.01) -> Column:
    """Whether a number is one of the given numbers or the sum of some of the first twelve."""
    direct = F.exists(numbers, lambda n: close(target, n, tolerance))
    return direct | F.exists(subset_sums(numbers), lambda s: close(target, s, tolerance))


def indian_scale(value: Column, unit: Column) -> Column:
    """A value in crore, lakh, thousand or million as a plain number."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return value * F.when(u.contains("crore"), 1e7).when(u.contains("lakh"), 1e5).when(u.contains("thousand"), 1e3).when(u.contains("million"), 1e6).otherwise(1.0)


def plain_text(c: Column) -> Column:
    """A number as text without exponent or trailing zeros (230.0 gives '230')."""
    fixed = c.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def grouped(c: Column, indian: bool = False) -> Column:
    """A number with thousands commas and at most three decimals; with `indian`, in groups of two above the thousands."""
    text = plain_text(F.round(c, 3))
    whole, rest = F.regexp_extract(text, r"^(-?[0-9]+)", 1), F.regexp_extract(text, r"(\.[0-9]+)$", 1)
    pattern = r"(?<=[0-9])(?=([0-9]{2})*[0-9]{3}$)" if indian else r"(?<=[0-9])(?=([0-9]{3})+$)"
    return F.concat(F.regexp_replace(whole, pattern, ","), rest)


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal; 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part * 1000, whole)) / 10, F.lit(0.0))


def computed_twice(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """STRUCT(proof_type, reason): COMPUTED where two computations of one figure agree, else REJECTED."""
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    proof = F.when(~bad & (F.abs(a - b) <= tolerance), "COMPUTED").otherwise("REJECTED")
    return F.struct(proof.alias("proof_type"), F.when(bad, "not a number").when(proof == "REJECTED", "the two paths differ").alias("reason"))


def image_size_ok(width: Column, height: Column, most_side: int = 10_000, most_pixels: int = 40_000_000) -> Column:
    return (width > 0) & (height > 0) & (width <= most_side) & (height <= most_side) & (width.cast("long") * height <= most_pixels)
