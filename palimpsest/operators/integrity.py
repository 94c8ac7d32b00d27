"""Referential checks as anti-joins. Every check gives rows (check, record, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.strings import kind_of, rest_of

FAILURES = "check string, record string, message string"


class EngineError(Exception):
    """A failure that ends a command: which check, and what it found."""

    def __init__(self, check: str, message: str):
        super().__init__(f"{check}: {message}")


def failures(df: DataFrame, check: str, record: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), record.cast("string").alias("record"), message.cast("string").alias("message"))


def union_failures(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def says(what: str, value: Column) -> Column:
    return F.concat(F.lit(what + " '"), value.cast("string"), F.lit("'"))


def missing_target(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str, record: str) -> DataFrame:
    """Rows whose non-null key is not among the parent's."""
    keys = parent.select(F.col(parent_key).alias("_k"))
    lost = child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_k"), "left_anti")
    return failures(lost, check, F.col(record), says(f"unknown {key}", F.col(key)))


def self_reference(df: DataFrame, key: str, ref: str, check: str) -> DataFrame:
    return failures(df.where(F.col(key) == F.col(ref)), check, F.col(key), says(f"{ref} is itself", F.col(ref)))


def orphans(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Parents that no child row names."""
    return parent.join(child.select(F.col(child_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def first_duplicate(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Every row of a key after the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def listed_duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key).orderBy(key)


def polymorphic_target(df: DataFrame, ref: str, targets: dict[str, tuple[DataFrame, str]], check: str, record: str) -> DataFrame:
    """References ``kind:value`` whose value its kind's table lacks; unknown kinds pass."""
    known = reduce(DataFrame.unionByName, (t.select(F.lit(kind).alias("_kind"), F.col(k).cast("string").alias("_value")) for kind, (t, k) in targets.items()))
    own = df.withColumns({"_rk": kind_of(F.col(ref)), "_rv": rest_of(F.col(ref))}).where(F.col("_rk").isin(*targets))
    lost = own.join(known, (F.col("_rk") == F.col("_kind")) & (F.col("_rv") == F.col("_value")), "left_anti")
    return failures(lost, check, F.col(record), says("unknown source", F.col(ref)))


def array_target(df: DataFrame, array: str, parent: DataFrame, parent_key: str, check: str, record: str) -> DataFrame:
    each = df.select(F.col(record).alias("_r"), F.explode(array).alias("_v"))
    lost = each.join(parent.select(F.col(parent_key).alias("_k")), F.col("_v") == F.col("_k"), "left_anti")
    return failures(lost, check, F.col("_r"), says(f"{array} names unknown", F.col("_v")))


def not_contained(df: DataFrame, value: str, on: str, parent: DataFrame, parent_key: str, array: str, check: str, record: str) -> DataFrame:
    """Rows whose known parent does not list their value."""
    own = df.join(parent.select(F.col(parent_key).alias("_k"), F.col(array).alias("_a")), F.col(on) == F.col("_k"))
    return failures(own.where(~F.array_contains("_a", F.col(value))), check, F.col(record), says(f"{value} is not in {on}", F.col(value)))


def inconsistent_link(df: DataFrame, ids: str, target: DataFrame, target_id: str, agrees: Column, check: str, record: str) -> DataFrame:
    """Linked pairs that do not agree; ``agrees`` may speak of the columns of both sides."""
    each = df.withColumn("_id", F.explode(ids)).join(target, F.col("_id") == F.col(target_id))
    return failures(each.where(~agrees), check, F.col(record), says("link disagrees with", F.col("_id")))


def lacking(df: DataFrame, evidence: DataFrame, on: Column, check: str, record: str, message: str) -> DataFrame:
    """Rows for which no row of evidence exists."""
    return failures(df.join(evidence, on, "left_anti"), check, F.col(record), F.lit(message))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def exactly_one(wanted: DataFrame, key: str, found: DataFrame, found_key: str) -> DataFrame:
    """``status`` of each key: missing, ambiguous or verified."""
    n = found.groupBy(F.col(found_key).alias("_k")).agg(F.count("*").alias("_n"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("verified")
    return wanted.join(n, F.col(key) == F.col("_k"), "left").withColumn("status", status).drop("_k", "_n")


def same_order(rows: DataFrame, key: str, position: str, expected: list[str]) -> bool:
    return [r[key] for r in rows.orderBy(position).select(key).limit(len(expected) + 1).collect()] == expected


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count("*").alias("n")).orderBy("check")


def rendered(found: DataFrame) -> DataFrame:
    return found.orderBy("check", "record", "message").select(F.format_string("FAIL [%s] %s: %s", "check", "record", "message").alias("line"))
