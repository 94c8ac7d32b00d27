"""Corpus pipeline: toxicity, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; each is written to the shared folder and read again by ``run``, so a
lost executor never sends the work back over a stage.

Cases, for every stage: null and empty texts are clean, are no duplicates of
anything and are kept (as one end token each in the last); null ids sort last
and stay null; repeated rows of one id and text are treated alike and all kept;
ties go to the least id; an empty table stays empty; texts of any length are
read whole; other columns than those of documents are not carried along.
"""

from __future__ import annotations

import public_tokenizers
from palimpsest.llm import decontaminate, line_dedup, minhash, packing, toxicity
from palimpsest.llm.common import read, save
from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled documents it sees, does not reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("_p_score < 0.5").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of 30 words or more that an earlier place has."""
    return line_dedup.dedup_lines(docs).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return minhash.keep_first(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
