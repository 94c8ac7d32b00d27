"""Callers' columns with the names that the operators use themselves."""

import pytest
import public_tokenizers as P
from palimpsest.llm import common, decontaminate, line_dedup, minhash, packing, pii, quality_rules, token_files, toxicity, url_filter
from palimpsest.llm.lattice_lm import score as lm_score
from pyspark.sql import functions as F

NAMES = ["_p_id", "_p_hash", "_P_text", "_p_key", "_p_runs", "_p_score", "_p_spans", "_p_w", "_p_rid", "_p_drawn", "_p_url", "block", "start", "n_words", "host", "comp", "cls", "spans", "items", "score", "word"]
TEXT = " ".join(f"w{k}" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT), (2, TEXT), (3, None), (None, "idiot here")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"mine {n}").alias(n) for n in NAMES))


def same(out, docs, but=()):
    assert {c.lower() for c in docs.columns} <= {c.lower() for c in out.columns} and len({c.lower() for c in out.columns}) == len(out.columns)
    for r in out.collect():
        assert all(r[n] == f"mine {n}" for n in NAMES if n not in but)


def test_columns_are_carried_along(spark, docs):
    bench = spark.createDataFrame([("a", TEXT)], "item_id string, text string")
    model = toxicity.Model(["idiot", "moron"], 0.3, __import__("numpy").array([1.0, 1.0]), -0.5, 4.0, 0.0)
    same(line_dedup.dedup_lines(docs), docs, ["_p_runs"])
    same(minhash.keep_first(docs), docs)
    same(decontaminate.remove_documents(docs, bench), docs)
    scored = toxicity.score(docs, model)
    same(scored, docs, ["_p_score"])
    assert {r.doc_id: r._p_score > 0.5 for r in scored.collect()} == {1: False, 2: False, 3: False, None: True}
    same(toxicity.score(docs, None), docs, ["_p_score"])
    same(pii.pseudonymise(docs, b"k"), docs, ["_p_spans"])
    same(quality_rules.judge(docs, []), docs, ["n_words"])
    same(url_filter.judge(docs.withColumn("url", F.lit("http://a.b/c")), ([0.0] * url_filter.BUCKETS, 0.0)), docs, ["host", "score"])


def test_columns_do_not_reach_digests(spark, docs):
    assert packing.pack(docs, P.path("word_bpe_49k.json"), 2).count() == 4
    path = common.new_path(spark, "t")
    token_files.write(docs, path, P.path("byte_bpe_50k.json"), 0, 50257)
    assert token_files.read(spark, path).count() == 4
    assert lm_score(docs.withColumn("_p_learn", F.lit(True)), P.path("piece_bpe_32k.model")).count() == 4
    assert decontaminate.judge(docs, spark.createDataFrame([("a", TEXT)], "item_id string, text string")).where("n_hit = 60").count() == 2
