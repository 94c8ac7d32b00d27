"""Row rules as data: (path, rule, argument) compiled to predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.integrity import failures

# Names of the geographic reference that coordinates may declare.
CRS_NAMES = ["urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:EPSG::4326", "EPSG:4326"]
PATTERNS = {
    "slug": r"^[a-z0-9]+(-[a-z0-9]+)*\z",
    "sha256": r"^[0-9a-f]{64}\z",
    "source_ref": r"^(topo:[A-Za-z0-9][A-Za-z0-9_.-]*|candidate:[a-z0-9]+(-[a-z0-9]+)*)\z",
    "area_id": r"^q7p5-\d+-\d+\z",
    "edition_id": r"^[a-z0-9]+(-[a-z0-9]+)*\z",
}


def ordered_box(w: Column, s: Column, e: Column, n: Column) -> Column:
    return (w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90)


def bad_position(coords: Column) -> Column:
    """Some position of an array of [lon, lat] is out of range or not two numbers."""
    return F.exists(coords, lambda p: (F.size(p) != 2) | (F.abs(F.get(p, F.lit(0))) > 180) | (F.abs(F.get(p, F.lit(1))) > 90))


def violated(rule: str, path: str, arg: object) -> Column:
    c = F.col(path)
    if rule == "required":
        return c.isNull()
    if rule == "pattern":
        return ~c.rlike(PATTERNS.get(arg, arg))
    if rule == "enum":
        return ~c.isin(*arg)
    if rule == "range":
        return ~c.between(*arg)
    if rule == "multiple_of":
        return c % arg != 0
    if rule == "minimum":
        return c < arg
    if rule == "unique":
        return F.size(c) != F.size(F.array_distinct(c))
    if rule == "min_items":
        return F.size(c) < arg
    if rule == "all_or_none":
        known = sum((F.col(p).isNotNull().cast("int") for p in [path, *arg]), F.lit(0))
        return (known != 0) & (known != 1 + len(arg))
    if rule == "requires":
        return c.isNotNull() & F.col(arg).isNull()
    if rule == "if_then_not_null":
        value, other = arg
        return (c == value) & F.col(other).isNull()
    if rule == "if_then_null":
        value, other = arg
        return (c == value) & F.col(other).isNotNull()
    if rule == "geometry_type":
        return c.isNull() | ~c.isin(*arg)
    if rule == "positions":
        return F.size(F.array_distinct(c)) < arg
    if rule == "in_range":
        return bad_position(c)
    if rule == "crs":
        return c.isNotNull() & ~c.isin(*CRS_NAMES)
    if rule == "expression":
        return ~F.expr(str(arg))
    raise ValueError(f"no such rule: {rule}")


def check_rows(df: DataFrame, rules: list[tuple[str, str, object]], record: str, check: str = "schema") -> DataFrame:
    """A failure per row and rule, from one pass over the rows."""
    found = F.array(*(F.when(F.coalesce(violated(rule, path, arg), F.lit(False)), F.lit(f"{path}: {rule}" + ("" if arg is None else f" {arg}"))) for path, rule, arg in rules))
    each = df.select(F.col(record).alias("_r"), F.explode(F.filter(found, lambda m: m.isNotNull())).alias("_m"))
    return failures(each, check, F.col("_r"), F.col("_m"))


def unknown_keys(df: DataFrame, raw: str, allowed: list[str], record: str, check: str = "schema") -> DataFrame:
    """Keys of a JSON object column that the closed schema lacks."""
    each = df.select(F.col(record).alias("_r"), F.explode(F.json_object_keys(raw)).alias("_k")).where(~F.col("_k").isin(*allowed))
    return failures(each, check, F.col("_r"), F.concat(F.lit("unknown property "), F.col("_k")))


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)
