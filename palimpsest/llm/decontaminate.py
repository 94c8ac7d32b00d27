"""Benchmark decontamination by a broadcast set of n-grams (operator 10).

Everything is a DataFrame expression. The windows of the benchmark are hashed
and become a hash set inside the plan while they are fewer than
``max_set``; beyond that the windows are joined instead. A window of n words
must hold a whole aligned block of (n + 1) // 2 words, so a document is first
scanned at aligned blocks only, and those with a hit are scanned at every word.
Hits are then verified word by word against the windows. There is one scan of
the documents and one shuffle, which holds ids and hits but no texts.

Cases: null or wordless documents have no words and no hits; null or wordless
items have no windows; an item without an id makes hits but is not counted
among the items; rows that agree in id and text are one document and give one
row; empty tables give no hits; a text of any length is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, aside, read, restored, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def ngrams(bench: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``hash``, ``size``, ``gram`` (words) and ``items``."""
    own = bench.select(bench[item].cast("string").alias("item"), words(text_of(bench, text)).alias("w")).where("size(w) > 0")
    windows = own.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))")).alias("gram"))
    return windows.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.expr("xxhash64(gram)").alias("hash"), F.size("gram").alias("size"), "gram", "items")


def _starts(sizes: list[int], hashes: dict[int, list[int]]) -> Column:
    """Start, size and hash of each window of the row's words that is in the set."""
    def windows(size: int) -> Column:
        spots = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - (size - 1))).otherwise(F.array().cast("array<int>"))
        each = F.transform(spots, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice("w", i, F.lit(size))).alias("hash")))
        return F.filter(each, lambda s: s["hash"].isin(hashes[size]))

    return F.concat(*map(windows, sizes))


def _may_hit(block: int, blocks: list[int]) -> Column:
    """Whether an aligned block of words is part of some window."""
    return F.exists(
        F.when(F.size("w") >= block, F.sequence(F.lit(1), F.size("w") - (block - 1), F.lit(block))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice("w", i, F.lit(block))).isin(blocks),
    )


def hits(docs: DataFrame, bench: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", max_set: int = 200_000) -> DataFrame:
    """One row per document word window that occurs in the benchmark.

    Columns: ``key``, ``_p_text`` (hash of the text), ``n_words``, and ``at``,
    ``size`` (of the window, in words) and ``items``; a document without hits
    has one row with nulls in these.
    """
    grams = ngrams(bench, n)
    count = grams.count()
    base = docs.select(docs[key].cast("long").alias(key), F.xxhash64(text_of(docs, text)).alias("_p_text"), words(text_of(docs, text)).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    if count == 0:
        return base.drop("w").withColumns({"at": F.lit(None).cast("int"), "size": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")})
    if count <= max_set:
        rows = grams.select("hash", "size").collect()  # at most max_set
        hashes: dict[int, list[int]] = {}
        for r in rows:
            hashes.setdefault(r["size"], []).append(r["hash"])
        block = (min(hashes) + 1) // 2
        blocks = [r[0] for r in grams.select(F.explode(F.expr(f"transform(sequence(1, size(gram) - {block - 1}), i -> xxhash64(slice(gram, i, {block})))")).alias("h")).distinct().collect()]
        nothing = F.array().cast("array<struct<at:int,size:int,hash:bigint>>")
        found = F.when(_may_hit(block, blocks), _starts(sorted(hashes), hashes)).otherwise(nothing)
        windows = F.broadcast(grams)
    else:
        sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most n
        found = F.concat(*(F.expr(f"transform(if(size(w) >= {s}, sequence(1, size(w) - {s - 1}), array()), i -> struct(int(i) AS at, {s} AS size, xxhash64(slice(w, i, {s})) AS hash))") for s in sizes))
        windows = grams
    # the words of a hit are cut out before the rows are made, which then leave the text behind
    cut = F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"), s["hash"].alias("hash"), F.slice("w", s["at"], s["size"]).alias("gram")))
    each = base.select(key, "_p_text", "n_words", F.explode_outer(cut).alias("hit")).select(key, "_p_text", "n_words", "hit.at", "hit.size", "hit.hash", "hit.gram")
    joined = each.join(windows.select("hash", "gram", "items"), ["hash", "gram"], "left")
    real = F.col("items").isNotNull()
    return joined.select(key, "_p_text", "n_words", F.when(real, F.col("at")).alias("at"), F.when(real, F.col("size")).alias("size"), "items")


def judge(docs: DataFrame, bench: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", max_set: int = 200_000) -> DataFrame:
    """Per document: words, words hit, ``spans`` of hit words and the ``items``."""
    per_doc = (
        hits(docs, bench, n, key, text, max_set)
        .groupBy(key, "_p_text", "n_words")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("end"))))).alias("s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    merged = F.expr(
        """aggregate(s, array(), (out, x) ->
             CASE WHEN size(out) > 0 AND x.at <= element_at(out, -1).end
                  THEN concat(slice(out, 1, size(out) - 1), array(named_struct('at', element_at(out, -1).at, 'end', greatest(element_at(out, -1).end, x.end))))
                  ELSE concat(out, array(x)) END)""".replace("array(),", "cast(array() AS array<struct<at:int,end:int>>),")
    )
    hit = F.expr("aggregate(s, struct(0L AS n, 0 AS reach), (a, x) -> struct(a.n + greatest(0, x.end - greatest(x.at, a.reach)) AS n, greatest(a.reach, x.end) AS reach), a -> a.n)")
    return per_doc.select(key, "_p_text", "n_words", hit.alias("n_hit"), merged.alias("spans"), "items")


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without those that hold a window."""
    docs, names = aside(docs)
    back = {c: new for new, c in names.items()}
    key, text = back.get(key, key), back.get(text, text)
    dirty = judge(docs, bench, n, key, text).where("n_hit > 0").select(F.col(key).alias("_p_key"), F.col("_p_text").alias("_p_hash"))
    mine = F.col("_p_key").eqNullSafe(docs[key].cast("long")) & (F.col("_p_hash") == F.xxhash64(text_of(docs, text)))
    return restored(docs.join(dirty, mine, "left_anti"), names)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    verdicts = judge(docs, read(spark, sf_dir, "benchmark"))
    return verdicts.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM t JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
