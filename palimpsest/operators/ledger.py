"""Append-once ledgers, digests, and receipts against what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.integrity import EngineError


def conflicts(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys that carry more than one payload."""
    return rows.groupBy(*keys).agg(F.min(payload).alias("lo"), F.max(payload).alias("hi")).where("lo <> hi").select(*keys)


def append_once(ledger: DataFrame, new: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows of ``new`` that the ledger lacks; the same key with other content is an error."""
    both = ledger.select(*keys, payload).unionByName(new.select(*keys, payload))
    bad = conflicts(both, keys, payload).limit(5).collect()
    if bad:
        raise EngineError("ledger", f"other content for {[tuple(r) for r in bad]}")
    return new.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.col(order)).alias("_r")).select("_r.*")


def digest_of_lines(df: DataFrame, keys: list[str], line) -> DataFrame:
    """SHA-256 over a group's sorted lines, which must fit one row (an inventory's names)."""
    lines = F.array_sort(F.collect_list(line))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("n"))


def file_digests(spark, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of files, read where they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("byte_count"), F.sha2("content", 256).alias("sha256"))


# Fixed value: bytes by which an unreceipted file may differ from the size that the index states.
SIZE_TOLERANCE = 16


def plan_status(index: DataFrame, receipts: DataFrame, disk: DataFrame, key: str = "topo_id") -> DataFrame:
    """``status`` (missing, mismatch, present) and ``detail`` of each row of the index.

    A file with a receipt must have its size and hash. One without needs a review
    if it is empty, and else must be near the index's ``size_bytes``, where that is
    a number. ``disk``: key, byte_count, sha256 of the files that are there.
    """
    r = receipts.select(F.col(key).alias("_rk"), F.col("sha256").alias("_rh"), F.col("byte_count").alias("_rn"))
    d = disk.select(F.col(key).alias("_dk"), F.col("sha256").alias("_dh"), F.col("byte_count").alias("_dn"))
    out = index.join(r, F.col(key) == F.col("_rk"), "left").join(d, F.col(key) == F.col("_dk"), "left")
    size = F.when(F.col("size_bytes").rlike(r"^\d+\z"), F.col("size_bytes").try_cast("long"))

    def says(status: str, detail: str):
        return F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))

    receipted = F.col("_rk").isNotNull()
    verdict = (
        F.when(F.col("_dk").isNull() & receipted, says("missing", "receipted file absent"))
        .when(F.col("_dk").isNull(), says("missing", "not fetched"))
        .when(receipted & ~F.col("_rn").eqNullSafe(F.col("_dn")), says("mismatch", "size differs from the receipt"))
        .when(receipted & ~F.col("_rh").eqNullSafe(F.col("_dh")), says("mismatch", "hash differs from the receipt"))
        .when(receipted, says("present", "verified against the receipt"))
        .when(F.coalesce(F.col("_dn"), F.lit(0)) == 0, says("mismatch", "file needs a review"))
        .when(F.abs(F.col("_dn") - size) > SIZE_TOLERANCE, says("mismatch", "size differs from the index"))
        .otherwise(says("present", "unreceipted file within tolerance"))
    )
    return out.withColumn("_v", verdict).select(*(F.col(c) for c in index.columns), "_v.status", "_v.detail")


def stale(plans: DataFrame, record: DataFrame, key: str) -> DataFrame:
    """Plans whose fingerprint or output hash is not the recorded one: what must be made again."""
    done = record.select(F.col(key).alias("_k"), F.col("fingerprint").alias("_f"), F.col("output_sha256").alias("_o"))
    same = (F.col(key) == F.col("_k")) & F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("output_sha256").eqNullSafe(F.col("_o"))
    return plans.join(done, same, "left_anti")


TIFF_MAGIC = ["49492A00", "4D4D002A", "49492B00", "4D4D002B"]


def looks_like_tiff(content):
    return F.hex(F.substring(content, 1, 4)).isin(*TIFF_MAGIC)


def pdf_problem(content, size):
    tail = F.expr(f"substring({content}, greatest(length({content}) - 1023, 1), 1024)")
    return (
        F.when(F.length(content) != size, "wrong length")
        .when(~F.startswith(F.col(content), F.lit(b"%PDF-")), "no header")
        .when(~F.contains(tail, F.lit(b"%%EOF")), "no end marker")
    )
