"""Packing of tokenised documents into sequences (operator 2).

Documents are tokenised once and written, with a rank inside their task and
length class. Full-length chunks become sequences of their own. What remains
of each document falls into one of ``capacity / quantum`` classes; that
bounded histogram goes to the driver, which solves the cutting-stock problem
(see ``cutting_stock``). The plan is a bounded table of rank ranges, so each
document finds the slots of its pieces by its rank alone, and only narrow rows
are shuffled for offsets. Ids are joined to the pieces last.

Cases: null texts are empty documents, which hold the end id alone; null ids
are kept; repeated rows are packed as often as they occur; an empty table
gives no pieces; texts of any length are cut at full sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.chunk_tokens import tokenizer
from palimpsest.llm.common import read, save, text_of
from palimpsest.llm.cutting_stock import plan
from palimpsest.llm.textblocks import binary_rows, slices

_TOKENS = "doc_id long, part int, row long, doc_tokens long, full long, full_before long, cls int, in_class long, ids binary"


def _tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, quantum: int) -> DataFrame:
    classes = -(-capacity // quantum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, full_before = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(classes + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, "_p_text", 8 << 20):
                ids, sizes = tokenizer(tokenizer_path).encode(piece.column("_p_text"), end_id)
                n = len(sizes)
                full, rest = sizes // capacity, sizes % capacity
                cls = -(-rest // quantum)
                order = np.argsort(cls, kind="stable")
                ranked = cls[order]
                first = np.searchsorted(ranked, ranked)
                in_class = np.empty(n, np.int64)
                in_class[order] = np.arange(n) - first + seen[ranked]
                seen += np.bincount(cls, minlength=classes + 1)
                before = np.cumsum(full) - full + full_before
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("_p_doc"),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(row, row + n)),
                        pa.array(sizes),
                        pa.array(full),
                        pa.array(before),
                        pa.array(cls.astype(np.int32)),
                        pa.array(in_class),
                        binary_rows(ids, sizes).cast(pa.binary()),
                    ],
                    names=["doc_id", "part", "row", "doc_tokens", "full", "full_before", "cls", "in_class", "ids"],
                )
                row, full_before = row + n, full_before + int(full.sum())

    return docs.mapInArrow(run, _TOKENS)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 4096,
    quantum: int = 8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece, with its ids as little-endian 32-bit binary.

    ``sequence_id`` and ``offset`` place a piece; the offsets of a sequence
    have no gaps. ``start`` and ``length`` place it in its document.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[key].cast("long").alias("_p_doc"), text_of(docs, text).alias("_p_text"))
    tokens = save(_tokenise(plain, tokenizer_path, end_id, capacity, quantum), "packing-tokens")
    narrow = tokens.drop("ids")

    counts = narrow.groupBy("part", "cls").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    totals = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most a row per class
    demand = np.array([totals.get(k, 0) for k in range(1, -(-capacity // quantum) + 1)])
    slots, used = plan(demand)

    by_class = Window.partitionBy("cls").orderBy("part")
    base = counts.select("part", "cls", (F.sum("n").over(by_class) - F.col("n")).alias("_p_base"))
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))  # a row per task
    full_base = parts.select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("_p_full"))

    full = (
        narrow.where("full > 0")
        .join(full_base, "part")
        .select("part", "row", "doc_id", "doc_tokens", (F.col("_p_full") + F.col("full_before") + F.lit(used)).alias("_p_seq"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("_p_k"))
        .select("part", "row", "doc_id", "doc_tokens", (F.col("_p_k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("_p_seq") + F.col("_p_k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    rows = [tuple(map(int, (s.source, s.low, s.high, s.offset, s.length, s.sequence, s.copies, s.first))) for s in slots]
    fields = ["low", "high", "offset", "length", "sequence", "copies", "first"]
    slot_table = spark.createDataFrame(rows, "cls int, " + ", ".join(f"{f} long" for f in fields))
    by_source = slot_table.groupBy("cls").agg(F.collect_list(F.struct(*fields)).alias("_p_slots"))  # bounded by the plan
    rest = (
        narrow.where("cls > 0")
        .join(base, ["part", "cls"])
        .join(F.broadcast(by_source), "cls")
        .withColumn("_p_rank", F.col("in_class") + F.col("_p_base"))
        .select("part", "row", "doc_id", "doc_tokens", "full", "_p_rank", F.explode(F.expr("filter(_p_slots, s -> s.low <= _p_rank AND _p_rank < s.high)")).alias("s"))
        .select(
            "part",
            "row",
            "doc_id",
            "doc_tokens",
            (F.col("full") * capacity + F.col("s.offset") * quantum).alias("start"),
            F.col("s.length").alias("_p_len"),
            (F.col("s.sequence") + (F.col("s.first") + F.col("_p_rank") - F.col("s.low")) % F.col("s.copies")).alias("sequence_id"),
        )
        .withColumn("length", F.least(F.col("_p_len") * quantum, F.col("doc_tokens") - F.col("start")))
    )
    inside = Window.partitionBy("sequence_id").orderBy("part", "row", "start")
    rest = rest.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*full.columns)
    ids = tokens.select("part", "row", "ids")
    return (
        full.unionByName(rest)
        .join(ids, ["part", "row"])
        .select("doc_id", "start", "length", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"), "doc_tokens", "sequence_id", "offset")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return digest(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
