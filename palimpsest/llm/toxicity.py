"""Toxicity by a subsequence string-kernel machine (operator 9).

Landmarks are words that set labelled toxic documents apart. A document is the
set of its words, with marks inside words taken out and spaced-out letters put
together; its kernel with a landmark is that of its most similar word, so gaps
and inserted characters lower it only a little. Nyström's map turns kernels
into features, a squared-hinge support vector machine separates them, and a
logistic curve turns margins into scores. Only the model travels: at most
``landmarks`` words and as many weights.

Training looks at no more than ``positives`` and ``negatives`` labelled
documents, the first by hash of id, and never at the held-out fold.

Cases: null and empty texts have no words and get the score of the intercept;
repeated labels of an id count once, toxic if any says so; null labels and ids
teach nothing; without labels of both kinds all scores are 0; texts are read
whole, whatever their length, some 4 MB of them at a time; rows of one text get
one score, and so do repeated rows; a caller's column ``_p_score`` is replaced;
an empty table stays empty. Landmarks have three characters at least, as the
kernel compares triples; shorter insults are not learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from palimpsest.llm.common import aside, read, restored, save, text_of
from palimpsest.llm.string_kernel import Landmarks, clean, norm, phi
from palimpsest.llm.textblocks import slices, words_of


def held_out(key: Column, of: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the text ``null``."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % of == rest, F.lit(False))


def _bag(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct cleaned words, and for each word in its text: its number and its text."""
    words = words_of(texts, lower=True)
    values = [clean(v) for v in words.values.to_pylist()]
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    codes = words.codes
    if len(codes):
        single = np.fromiter((len(v) == 1 or (len(v) < 5 and len(v.decode("utf-8", "replace")) == 1) for v in values), bool, len(values))[codes]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        extra, where = [], []
        for a, b in zip(begin[end - begin > 2], end[end - begin > 2], strict=True):
            for at in np.split(np.arange(a, b), np.flatnonzero(np.diff(text[a:b])) + 1):
                if len(at) > 2:
                    extra.append(b"".join(values[codes[k]] for k in at))
                    where.append(text[at[0]])
        if extra:
            codes = np.concatenate([codes, len(values) + np.arange(len(extra))])
            text = np.concatenate([text, where])
            values += extra
    return values, codes, text


def pooled(texts: pa.Array, marks: Landmarks) -> np.ndarray:
    """Similarity of each text's nearest word to each landmark."""
    values, codes, text = _bag(texts)
    out = np.zeros((len(texts), len(marks.words)))
    near, rows = marks.similar(values)
    if len(near):
        row = np.full(len(values), -1)
        row[near] = np.arange(len(near))
        use = np.flatnonzero(row[codes] >= 0)
        pairs = np.unique(text[use].astype(np.int64) * len(near) + row[codes[use]])
        np.maximum.at(out, pairs // len(near), rows[pairs % len(near)])
    return out


STEM = 5
_SLICE = 4 << 20


@dataclass
class Model:
    words: list[str]
    floor: float
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def machine(features: np.ndarray, toxic: np.ndarray, gram: np.ndarray, ridge: float = 1e-2, words: list[str] | None = None, floor: float = 0.0) -> Model:
    """Nyström map, then a squared-hinge machine by Newton steps, then a logistic curve."""
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = np.hstack([features @ root, np.ones((len(features), 1))])
    y = np.where(toxic, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge * len(y) / 100)
    keep[-1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        h = x[active].T @ x[active] + np.diag(keep)
        new = np.linalg.solve(h, x[active].T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    margin = x @ w
    a, b = 1.0, 0.0
    p = np.array([a, b])
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -50, 50)))
        h = (design * (q * (1 - q))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (q - target) + 1e-6 * p)
        p = p - np.clip(step, -5, 5)
    return Model(words or [], floor, root @ w[:-1], float(w[-1]), float(p[0]), float(p[1]))


def choose(candidates: list[tuple[str, int, int]], toxic: int, clean_docs: int, landmarks: int, alike: float = 0.8) -> list[str]:
    """Landmarks: words with the largest evidence that are not all alike."""
    ranked = sorted(candidates, key=lambda c: (-c[1] * math.log((c[1] / toxic) / ((c[2] + 0.5) / clean_docs)), c[0]))
    out: list[str] = []
    seen: list[tuple[dict, float]] = []
    for word, _, _ in ranked:
        f = phi(word)
        n = norm(f)
        if n and all(sum(v * g.get(t, 0.0) for t, v in f.items()) < alike * n * m for g, m in seen):
            out.append(word)
            seen.append((f, n))
        if len(out) == landmarks:
            break
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    positives: int = 4000,
    negatives: int = 8000,
    landmarks: int = 96,
    floor: float = 0.3,
) -> Model | None:
    known = labels.select(labels[key].cast("long").alias("_p_key"), labels[label].cast("int").alias("_p_y")).dropna().where(~held_out(F.col("_p_key")))
    known = known.groupBy("_p_key").agg(F.max("_p_y").alias("_p_y"))
    order = [F.xxhash64("_p_key"), F.col("_p_key")]
    sample = known.where("_p_y = 1").orderBy(*order).limit(positives).unionByName(known.where("_p_y = 0").orderBy(*order).limit(negatives))
    # half of the distinct texts give the landmarks and the other half their weights,
    # so that words which only chance has put into toxic documents get none
    few = (
        docs.select(docs[key].cast("long").alias("_p_key"), text_of(docs, text).alias("_p_text"))
        .join(F.broadcast(sample), "_p_key")
        .groupBy(F.xxhash64("_p_text").alias("_p_hash"))
        .agg(F.min("_p_key").alias("_p_key"), F.first("_p_text").alias("_p_text"), F.max("_p_y").alias("_p_y"))
        .withColumn("_p_half", F.pmod("_p_hash", F.lit(2)).cast("int"))
        .select("_p_key", "_p_text", "_p_y", "_p_half")
    )
    few = save(few, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_p_text", _SLICE):
                values, codes, where = _bag(part.column("_p_text"))
                if not values:
                    continue
                y = part.column("_p_y").to_numpy(zero_copy_only=False)
                # words, and the stems that inflected forms of a word share
                terms: dict[str, int] = {}
                whole = np.array([terms.setdefault(v.decode("utf-8", "replace"), len(terms)) for v in values])
                stems = np.array([terms.setdefault(v.decode("utf-8", "replace")[:STEM], len(terms)) for v in values])
                term = np.concatenate([whole[codes], stems[codes]])
                pairs = np.unique(term.astype(np.int64) * part.num_rows + np.concatenate([where, where]))
                toxic = y[pairs % part.num_rows] == 1
                hit = np.bincount(pairs[toxic] // part.num_rows, minlength=len(terms))
                miss = np.bincount(pairs[~toxic] // part.num_rows, minlength=len(terms))
                names = list(terms)
                use = [k for k in np.flatnonzero(hit + miss) if len(names[k]) > 2]
                yield pa.RecordBatch.from_pydict({"word": [names[k] for k in use], "hit": hit[use].astype(np.int64), "miss": miss[use].astype(np.int64)})

    totals = {r["_p_y"]: r["n"] for r in few.where("_p_half = 0").groupBy("_p_y").agg(F.count("*").alias("n")).collect()}
    toxic, rest = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not rest:
        return None
    words = few.where("_p_half = 0").mapInArrow(count, "word string, hit long, miss long").groupBy("word").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    ratio = (F.col("hit") / toxic) / ((F.col("miss") + 0.5) / rest)
    top = words.where((F.col("hit") >= max(3, toxic // 200)) & (ratio > 8)).orderBy(F.desc(F.col("hit") * F.log(ratio)), "word").limit(2000)
    marks = choose([(r.word, r.hit, r.miss) for r in top.collect()], toxic, rest, landmarks)
    if not marks:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Landmarks(marks, floor)
        for batch in batches:
            for part in slices(batch, "_p_text", _SLICE):
                x = pooled(part.column("_p_text"), space)
                yield pa.RecordBatch.from_arrays([part.column("_p_key"), part.column("_p_y"), pa.array(list(x), pa.list_(pa.float64()))], names=["_p_key", "_p_y", "x"])

    rows = sorted((r["_p_key"], r["_p_y"], r["x"]) for r in few.where("_p_half = 1").mapInArrow(features, "_p_key long, _p_y int, x array<double>").collect())  # bounded by the sample
    if len({r[1] == 1 for r in rows}) < 2:
        return None
    space = Landmarks(marks, floor)
    return machine(np.array([r[2] for r in rows]), np.array([r[1] == 1 for r in rows]), space.gram(), words=marks, floor=floor)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``_p_score``, between 0 and 1."""
    docs, names = aside(docs)
    back = {c: new for new, c in names.items()}
    keep = [back.get(c, c) for c in keep] if keep is not None else docs.columns
    if model is None:
        return restored(docs.select(*keep).withColumn("_p_score", F.lit(0.0)), names)
    source = back.get(text, text)
    if docs.schema[source].dataType != StringType():
        docs, source = docs.withColumn("_p_text", text_of(docs, source)), "_p_text"
    schema = StructType([*(docs.schema[c] for c in keep), StructField("_p_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Landmarks(model.words, model.floor)
        for batch in batches:
            for part in slices(batch, source, _SLICE):
                s = model.scores(pooled(part.column(source), space))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], names=[*keep, "_p_score"])

    return restored(docs.select(*dict.fromkeys([*keep, source])).mapInArrow(run, schema), names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_p_score").alias("score"), (F.col("_p_score") >= 0.5).cast("int").alias("predicted"))
