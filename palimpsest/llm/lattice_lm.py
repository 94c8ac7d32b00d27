"""Document likelihood under a unigram subword lattice (operator 6).

The pieces are those of an existing vocabulary. Their weights start from its
scores and are re-estimated on the training documents by expectation
maximisation over all segmentations. Pieces do not cross words, so a text's
marginal is the product of its words' and of an end; each distinct word's is
worked out once.

The vocabulary files at hand hold ranks rather than probabilities, so this
departs from scoring with given weights: ``rounds`` of expectation maximisation
re-estimate them. With ``rounds=0`` the weights that the ranks give are used.

One pass turns each block of documents into a row for each of its distinct
words, with the documents and counts packed in bytes, and a row that lists the
block's documents. Word counts are sums over these rows, the piece weights are
sums over words (as many rows as pieces). Scores come from joining words back
to their rows, which then go to their block's task, where each block is added
up once, giving one row a document. A word of many blocks is a hot key of the
join only, which adaptive execution splits.

Cases: null and empty texts have no words, only the end; null ids count as the
text ``null`` for the fold; repeated rows are each scored, and each teaches;
with nothing to learn from, the base and the score stay defined by their
smoothing; an empty table gives no rows; texts and words of any length count;
only the key, the text and ``learn`` are read, whatever else is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import read, save, text_of
from palimpsest.llm.lattice import Lattice, load_pieces
from palimpsest.llm.line_dedup import buffer_of_binary
from palimpsest.llm.textblocks import binary_rows, slices, words_of
from palimpsest.llm.toxicity import held_out


_PAIR = np.dtype([("doc", "<u2"), ("times", "u1")])
_HEAD = np.dtype([("id", "<i8"), ("words", "<i8"), ("learned", "u1"), ("null", "u1")])
_DOCS = 1 << 16
_ROWS = "word binary, block long, data binary, train long"


def _bytes(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return binary_rows(np.ascontiguousarray(values).view(np.uint8), lengths * values.itemsize).cast(pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, block, pairs of document and times, count in training); the row without a word lists the block's documents."""
    block = TaskContext.get().partitionId() << 32
    names = ["word", "block", "data", "train"]
    for batch in batches:
        for wide in slices(batch, "_p_text"):
            for at in range(0, wide.num_rows, _DOCS):
                part = wide.slice(at, _DOCS)
                n = part.num_rows
                w = words_of(part.column("_p_text"), lower=True)
                train = part.column("_p_train").to_numpy(zero_copy_only=False)
                ids = part.column("_p_id")
                head = np.zeros(n, _HEAD)
                head["id"], head["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                head["words"], head["learned"] = np.diff(w.bounds), train
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([block]), _bytes(head, np.array([n])), pa.array([int(train.sum())])], names=names)
                doc = np.repeat(np.arange(n), np.diff(w.bounds))
                pairs, count = np.unique(w.codes.astype(np.int64) * n + doc, return_counts=True)
                code, doc = pairs // n, pairs % n
                seen = np.bincount(code, np.where(train[doc], count, 0), len(w.values)).astype(np.int64)
                # a pair counts to 255; more are more pairs
                repeat = (count + 254) // 255
                packed = np.zeros(repeat.sum(), _PAIR)
                packed["doc"], packed["times"] = np.repeat(doc, repeat), 255
                packed["times"][np.cumsum(repeat) - 1] = count - 255 * (repeat - 1)
                size = np.bincount(code, repeat, len(w.values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([w.values.cast(pa.binary()), pa.array(np.full(len(size), block)), _bytes(packed, size), pa.array(seen)], names=names)
                block += 1


def train(words: DataFrame, pieces: list[str], weights: np.ndarray, end: float, rounds: int = 2, smooth: float = 0.1) -> np.ndarray:
    """Piece weights after rounds of expectation maximisation over ``words`` (word, c)."""
    seen = words.where("c > 0")

    for _ in range(rounds):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, now, end), np.zeros(len(pieces))
            for b in batches:
                total += lattice.expected([v.decode() for v in b.column("word").to_pylist()], b.column("c").to_numpy().astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        sums = seen.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row per piece
        new = np.full(len(pieces), smooth)
        for r in sums:
            new[r.piece] += r.n
        weights = new / new.sum()
    return weights


def score(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", learn: str = "_p_learn", rounds: int = 2) -> DataFrame:
    """Scores of all ``docs``; those whose boolean column ``learn`` is true teach."""
    plain = docs.select(docs[key].cast("long").alias("_p_id"), F.coalesce(docs[learn], F.lit(False)).alias("_p_train"), text_of(docs, text).alias("_p_text"))
    rows = save(plain.mapInArrow(_blocks, _ROWS), "word-blocks")
    words = save(rows.where("word IS NOT NULL").groupBy("word").agg(F.sum("train").alias("c")), "words")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = rows.where("word IS NULL").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n")).first().n
    n, v = facts.n + ends, facts.v + (ends > 0)
    floor = math.log10(n + 0.5 * (v + 1))
    pieces, weights = load_pieces(model_path)
    end = (ends + 1) / (n + 2) if n else 0.5
    weights = train(words, pieces, weights, end, rounds)
    last = Lattice(pieces, weights, end).end / math.log(10)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Lattice(pieces, weights, end)
        for b in batches:
            marginal = local.marginals([w.decode() for w in b.column("word").to_pylist()]) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(marginal)], names=["word", "c", "marginal"])

    judged = save(words.mapInArrow(judge, "word binary, c long, marginal double"), "judged-words")

    def closed(head: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(head["id"], mask=head["null"] == 1),
                pa.array(head["learned"] == 1),
                pa.array(head["words"] + 1),
                pa.array(sums[0].astype(np.int64) + int(ends > 0)),
                pa.array(sums[1] + (math.log10(ends + 0.5) - floor)),
                pa.array(sums[2] + last),
            ],
            names=["id", "learned", "n_tokens", "n_known", "base_score", "score"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks, one after the other, each led by the list of its documents."""
        head, sums = np.zeros(0, _HEAD), np.zeros((3, 0))
        for b in batches:
            if not b.num_rows:
                continue
            raw, at = buffer_of_binary(b.column("data"))
            lists = b.column("c").is_null().to_numpy(zero_copy_only=False)
            c = b.column("c").fill_null(0).to_numpy()
            facts = np.stack([(c > 0).astype(float), np.log10(c + 0.5) - floor, b.column("marginal").fill_null(0).to_numpy()])
            first = np.flatnonzero(lists)
            for lo, hi in zip([0, *first], [*first, b.num_rows], strict=True):
                if lo < hi and lists[lo]:
                    if len(head):
                        yield closed(head, sums)
                    head = np.frombuffer(raw[at[lo] : at[lo + 1]], _HEAD)
                    sums = np.zeros((3, len(head)))
                    lo += 1
                if lo < hi:
                    pairs = np.frombuffer(raw[at[lo] : at[hi]], _PAIR)
                    word = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]) // _PAIR.itemsize)
                    for k in range(3):
                        sums[k] += np.bincount(pairs["doc"], facts[k, word] * pairs["times"], len(head))
        if len(head):
            yield closed(head, sums)

    joined = rows.where("word IS NOT NULL").select("word", "block", "data").join(judged, "word").select("block", "data", "c", "marginal")
    lists = rows.where("word IS NULL").select("block", "data", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("marginal"))
    by_block = joined.unionByName(lists).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("c"))
    out = by_block.mapInArrow(add, "id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(key), "learned", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_p_learn", ~held_out(F.col("doc_id"), 5, 1))
    out = score(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
