"""Removal of repeated passages by winnowing (operator 1).

Units are words, split at ASCII white space. A window is a run of ``min_words``
words; its fingerprint is the least hash among the k-grams in it, k being
eight, so that equal windows have equal fingerprints wherever they stand
in a line or a sentence. Fingerprints selected at one place only are dropped
after a count. The windows that select one place are a block. Of each repeated
fingerprint, equal blocks are compared first and each but the first, in order
of document id and position, is deleted. Where a fingerprint has blocks of
several contents (their least is not their largest), as at the edges of a passage, the windows of the first block
of each content are compared one by one in the same way, those that occur once
only being dropped before by a count of their contents alone. A window is so deleted
just if an equal one is earlier; windows overlap word by word, and a repeated
passage of ``min_words`` words or more goes from its first word to its last. No
pairs within a group are made: each occurrence meets the first one.

The tasks know the repeated fingerprints and windows by tables of ``_BITS``
bits, whose size is fixed; that these take others for repeated costs time, as
they meet no equal content.

The earliest occurrence of every word's text stays, as each deletion points to
an earlier place; of a passage that repeats with a period, one period stays.

Cases: null texts are empty and are not changed; null ids sort last; rows that
agree in id and text are one document and come out alike; a text that is wholly
repeated becomes empty and its row stays; an empty table stays empty; texts of
any length are compared whole; ties do not arise, as a place is an id, a text
and a word. ``n_chars``, if there, follows the text; other columns are carried
along, but for a caller's ``_p_runs``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import aside, id_of, read, remove, restored, save, text_of
from palimpsest.llm.textblocks import SPACE, binary_rows, buffer_of, mix, slices

_ODD = 0x9E3779B97F4A7C15
_GRAM = 8
_BITS = 1 << 25
_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_CODES[SPACE] = 0
_SLICE = 4 << 20


def word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text bounds in bytes, word starts, and text bounds in words."""
    raw, at = buffer_of(texts)
    gap = SPACE[raw]
    begin = ~gap
    begin[1:] &= gap[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begin[heads] = ~gap[heads]
    starts = np.flatnonzero(begin)
    return raw, at, starts, np.searchsorted(starts, at)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each run of ``width`` values."""
    at, step = np.arange(len(values)), 1
    while step < width:
        by = min(step, width - step)
        left, right = at[:-by], at[by:]
        at = np.where(values[right] < values[left], right, left)
        step += by
    return at


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Content hashes of the words that begin at ``starts``: polynomials of their bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw, at = raw[starts[0] :], starts - starts[0]
    size = np.diff(at, append=len(raw))
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), _ODD, np.uint64)]), dtype=np.uint64)
        return mix(np.add.reduceat(_CODES[raw] * power[place], at))


class Windows:
    """Runs of ``size`` words in a batch of texts: ``start``, ``text``, ``fingerprint``."""

    def __init__(self, texts: pa.Array, size: int):
        raw, _, starts, self.bounds = word_starts(texts)
        n, gram = len(starts), max(1, min(_GRAM, size // 2))
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.start = np.flatnonzero(np.arange(size, n + size) <= last)
        self.text = np.searchsorted(self.bounds, self.start, "right") - 1
        self.size = size
        with np.errstate(over="ignore"):
            self._inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(raw, starts) * power[:-1], dtype=np.uint64)])
        if len(self.start):
            grams = self._hash(np.arange(n - gram + 1), gram)
            self.place = least(grams, size - gram + 1)[self.start]
            self.fingerprint = grams[self.place]
        else:
            self.place, self.fingerprint = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _hash(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._prefix[at + length] - self._prefix[at]) * self._inverse[at])

    def blocks(self) -> np.ndarray:
        """First window of each block, in ``start``, and the end of the last."""
        return np.append(np.flatnonzero(np.diff(self.place, prepend=-1)), len(self.start))

    def selected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fingerprints, at how many places they are selected, and the least and largest content of their blocks."""
        edges = self.blocks()
        fps, content = self.fingerprint[edges[:-1]], self.contents(edges[:-1], edges[1:] - 1).view(np.int64)
        order = np.argsort(fps, kind="stable")
        fps, content = fps[order], content[order]
        first = np.flatnonzero(np.diff(fps, prepend=~fps[:1]))
        if not len(first):
            return fps, content, content, content
        return fps[first], np.diff(first, append=len(fps)), np.minimum.reduceat(content, first), np.maximum.reduceat(content, first)

    def contents(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words from window ``first`` to the end of ``last``."""
        size = self.start[last] - self.start[first] + self.size
        return mix(self._hash(self.start[first], size) ^ size.astype(np.uint64))


def buffer_of_binary(values: pa.Array) -> tuple[bytes, np.ndarray]:
    values = values.cast(pa.large_binary())
    n = len(values)
    if not n:
        return b"", np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    raw = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    return raw, at - at[0]


def _tables(fps: DataFrame, *tests: str) -> list[np.ndarray]:
    """For each test, the bits of the fingerprints in ``fps`` that pass it, as 64-bit numbers."""
    shift = 64 - (_BITS.bit_length() - 1)
    bit = f"shiftrightunsigned(fp, {shift})"
    flags = [f"CASE WHEN {t} THEN shiftleft(1L, cast({bit} & 63 AS int)) ELSE 0L END AS b{k}" for k, t in enumerate(tests)]
    words = fps.selectExpr(f"cast(shiftrightunsigned({bit}, 6) AS int) AS at", *flags).groupBy("at")
    got = words.agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(len(tests)))).toArrow()  # at most _BITS / 64 rows
    out = [np.zeros(_BITS // 64, np.int64) for _ in tests]
    for k, table in enumerate(out):
        table[got.column("at").to_numpy()] = got.column(f"b{k}").to_numpy()
    return [table.view(np.uint64) for table in out]


def _held(table: np.ndarray, fps: np.ndarray) -> np.ndarray:
    bit = fps >> np.uint64(64 - (_BITS.bit_length() - 1))
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges of each document apart and in order."""
    for b in batches:
        spans = b.column("spans")
        doc = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy())
        start, end = (x.to_numpy().astype(np.int64) for x in spans.flatten().flatten())
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        reach = np.maximum.accumulate((doc << 32) + end[order]) if len(doc) else doc
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] << 32) + start[1:] > reach[:-1]
        first = np.flatnonzero(new)
        ends = reach[np.append(first[1:], len(doc)) - 1] & 0xFFFFFFFF
        pairs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"])
        offsets = np.searchsorted(doc[first], np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("_p_id"), b.column("_p_hash"), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["_p_id", "_p_hash", "runs"])


def repeated_runs(docs: DataFrame, min_words: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Word ranges to delete: ``_p_id``, ``_p_hash`` (of the text) and ``runs``, merged and in order."""
    plain = docs.select(id_of(docs, key).alias("_p_id"), F.xxhash64(text_of(docs, text)).alias("_p_hash"), text_of(docs, text).alias("_p_text"))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_p_text", _SLICE):
                fps, n, lo, hi = Windows(part.column("_p_text"), min_words).selected()
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(lo), pa.array(hi)], names=["fp", "n", "lo", "hi"])

    context = docs.sparkSession.sparkContext
    marks = plain.select("_p_text").mapInArrow(selected, "fp long, n long, lo long, hi long")
    repeated = marks.groupBy("fp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1")
    table, mixed = map(context.broadcast, _tables(repeated, "true", "lo <> hi"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_p_text", _SLICE):
                w = Windows(part.column("_p_text"), min_words)
                edges = w.blocks()
                keep = np.flatnonzero(_held(table.value, w.fingerprint[edges[:-1]]))
                first, last = edges[:-1][keep], edges[1:][keep] - 1
                doc, size = w.text[first], last - first + 1
                shown = np.where(_held(mixed.value, w.fingerprint[first]), size, 0)
                each = np.repeat(first - np.cumsum(shown) + shown, shown) + np.arange(shown.sum())
                start = w.start[first] - w.bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.fingerprint[first].view(np.int64)),
                        pa.array(w.contents(first, last).view(np.int64)),
                        part.column("_p_id").take(pa.array(doc)),
                        part.column("_p_hash").take(pa.array(doc)),
                        pa.array(start.astype(np.int32)),
                        pa.array((start + size - 1 + min_words).astype(np.int32)),
                        binary_rows(w.contents(each, each), shown).cast(pa.binary()),
                    ],
                    names=["fp", "content", "_p_id", "_p_hash", "start", "end", "windows"],
                )

    place = F.struct("_p_id", "_p_hash", "start")
    found = save(plain.mapInArrow(blocks, "fp long, content long, _p_id long, _p_hash long, start int, end int, windows binary"), "word-blocks")
    kinds = save(found.groupBy("fp", "content").agg(F.min(place).alias("first"), F.first("windows").alias("windows"), F.count("*").alias("n")), "first-blocks")

    def inner(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of some blocks: block, start and content of each."""
        raw, at = buffer_of_binary(b.column("windows"))
        row = np.repeat(np.arange(b.num_rows), np.diff(at) // 8)
        start = b.column("start").to_numpy()[row] + np.arange(len(row)) - (at[:-1] // 8)[row]
        return row, start, np.frombuffer(raw, np.uint64)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, n = np.unique(inner(batch)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(n)], names=["fp", "n"])

    edges = kinds.where("length(windows) > 0").select("fp", "windows", "first.*")
    counts = edges.mapInArrow(contents, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1")
    again = context.broadcast(_tables(counts, "true")[0])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, content = inner(b)
            some = np.flatnonzero(_held(again.value, content))
            row, start = row[some], start[some]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(row)) for c in ("fp", "_p_id", "_p_hash")), pa.array(content[some].view(np.int64)), pa.array(start.astype(np.int32)), pa.array((start + min_words).astype(np.int32))],
                names=["fp", "_p_id", "_p_hash", "content", "start", "end"],
            )

    def later(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.drop("windows").join(known, ["fp", "content"]).where(place != F.col("first")).select("_p_id", "_p_hash", "start", "end")

    edge = save(edges.mapInArrow(windows, "fp long, _p_id long, _p_hash long, content long, start int, end int"), "edge-windows")
    whole = save(later(found, kinds.where("n > 1").select("fp", "content", "first")), "later-blocks")
    remove(found)
    remove(kinds)
    firsts = save(edge.groupBy("fp", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
    spans = whole.unionByName(later(edge, firsts))
    spans = spans.groupBy("_p_id", "_p_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return spans.mapInArrow(_merged, "_p_id long, _p_hash long, runs array<struct<start:int,end:int>>")


def dedup_lines(docs: DataFrame, min_words: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``_p_runs`` (null where nothing was)."""
    docs, names = aside(docs)
    back = {c: new for new, c in names.items()}
    key, text = back.get(key, key), back.get(text, text)
    runs = repeated_runs(docs, min_words, key, text).select(F.col("_p_id").alias("_p_rid"), F.col("_p_hash").alias("_p_rhash"), F.col("runs").alias("_p_runs"))
    fields = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column, runs = part.column(text), part.column("_p_runs").to_pylist()
                touched = [k for k, r in enumerate(runs) if r]
                if touched:
                    new = column.to_pylist()
                    raw, at, starts, bounds = word_starts(column)
                    data, edges = raw.tobytes(), np.append(starts, len(raw))
                    for k in touched:
                        kept, pos = [], int(at[k])
                        for r in runs[k]:
                            a, b = int(edges[bounds[k] + r["start"]]) if r["start"] else pos, min(int(edges[bounds[k] + r["end"]]), int(at[k + 1]))
                            kept.append(data[pos:a])
                            pos = b
                        kept.append(data[pos : int(at[k + 1])])
                        new[k] = b"".join(kept).decode()
                    part = part.set_column(part.schema.get_field_index(text), text, pa.array(new, column.type))
                yield part

    joined = docs.join(runs, (id_of(docs, key) == F.col("_p_rid")) & (F.xxhash64(text_of(docs, text)) == F.col("_p_rhash")), "left").drop("_p_rid", "_p_rhash")
    out = joined.mapInArrow(cut, joined.schema)
    if "n_chars" in fields:
        out = out.withColumn("n_chars", F.when(F.col("_p_runs").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return restored(out, names)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many words (the units) and runs of them are deleted, and the text that stays as length and hash."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    deleted = F.expr("aggregate(_p_runs, 0L, (n, r) -> n + r.end - r.start)")
    return out.select(
        "doc_id",
        F.coalesce(deleted, F.lit(0)).cast("long").alias("units_deleted"),
        F.when(F.col("_p_runs").isNull(), 0).otherwise(F.size("_p_runs")).cast("long").alias("runs_deleted"),
        F.col("n_chars").alias("chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
