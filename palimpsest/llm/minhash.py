"""Near duplicates by a chosen-path set similarity join (operator 8).

A document is the set of its 5-word shingles. Documents with equal sets are one
class, found by a hash of the set, and only the first of a class is compared.

Each class carries, for every tree and level, its least shingles under that
level's hash, and a sketch of 256 bins. A tree's root branches by the least
shingle. Nodes of one class end, and so do nodes whose classes all belong to
one component, so that large groups of copies do not grow into pairs. Nodes of
up to ``node`` classes are compared exhaustively: sketches rule out pairs far
below the threshold, and each pair left that is not connected yet is confirmed
on full sets. Larger nodes branch again by the two least shingles of the next
level, so that a pair has two chances to stay together; after the last level,
what is still too large is dealt into random blocks. A node of which one
component holds a quarter does not branch: a group of copies shares the next
shingles too, and would only stand in several nodes with the same others.

The first tree has its root only and serves to connect the large groups: its
large nodes are dealt out at once, with one class as an anchor in each block.
The others then run together. Nodes that did not branch or were dealt into blocks
there, and still hold several components, have all pairs of their blocks compared, but those in
which all belong to the node's largest component. A pair at the threshold in
small nodes is so missed with a chance of about 0.25 ** trees.

Cases: null, empty and wordless texts have an empty set, link with nothing and
are kept; null ids count as the largest id and come back as null; rows that
agree in id and text get the same answer; an empty table gives no rows; a text
with fewer than five words is one shingle; a document equal in its set to
several is linked to the least id; other columns are carried along by
``keep_first``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import aside, id_of, read, remove, restored, save, shuffle_partitions, text_of
from palimpsest.llm.components import components
from palimpsest.llm.line_dedup import buffer_of_binary
from palimpsest.llm.textblocks import binary_rows, hash_values, mix, slices, words_of

WORDS = 5
BINS = 256
TREES = 10
LEVELS = 3
NODE = 400
BROADCAST_ROWS = 200_000
_STEPS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) for k in range(WORDS)], np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has."""
    w = words_of(texts, lower=True)
    n = np.diff(w.bounds)
    if not len(w.codes):
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    word = mix(hash_values(w.values))[w.codes]
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    first = np.repeat(w.bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    long_text = np.repeat(n >= WORDS, count)
    owner = np.repeat(np.arange(len(n)), count)
    value = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        inside = long_text | (k < n[owner])
        value[inside] += mix(word[first[inside] + k] + _STEPS[k])
    value = mix(value + np.where(long_text, 0, n[owner]).astype(np.uint64))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n))


def _least(values: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    return np.minimum.reduceat(mix(values ^ mix(np.array([seed + 1], np.uint64))[0]), starts)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_p_text", 8 << 20):
            values, size = shingles(part.column("_p_text"))
            rows = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[rows]
            n = len(size)
            # the keys of empty sets differ, as they meet no class
            set_a, set_b = part.column("_p_id").to_numpy().copy(), part.column("_p_hash").to_numpy().copy()
            paths = np.zeros((n, TREES * (1 + 2 * (LEVELS - 1))), np.uint64)
            bins = np.zeros((n, BINS), np.uint8)
            if len(rows):
                set_a[rows] = np.add.reduceat(mix(values), starts).view(np.int64)
                set_b[rows] = np.add.reduceat(mix(values ^ np.uint64(0x5555555555555555)), starts).view(np.int64)
                for k in range(paths.shape[1]):
                    paths[rows, k] = _least(values, starts, k)
                owner = np.repeat(np.arange(n), size)
                h = mix(values ^ np.uint64(0xABCDEF0123456789))
                cell = owner * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
                order = np.lexsort((h, cell))
                cell, h = cell[order], h[order]
                lead = np.ones(len(cell), bool)
                lead[1:] = cell[1:] != cell[:-1]
                flat = bins.reshape(-1)
                flat[cell[lead]] = ((h[lead] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)  # 0: empty bin
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_p_id"),
                    part.column("_p_hash"),
                    pa.array(size),
                    pa.array(set_a),
                    pa.array(set_b),
                    binary_rows(paths.reshape(-1), np.full(n, paths.shape[1])).cast(pa.binary()),
                    binary_rows(bins.reshape(-1), np.full(n, BINS)).cast(pa.binary()),
                ],
                names=["_p_id", "_p_hash", "n_shingles", "set_a", "set_b", "paths", "sketch"],
            )


_SKETCH = "_p_id long, _p_hash long, n_shingles long, set_a long, set_b long, paths binary, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_p_text", 8 << 20):
            values, size = shingles(part.column("_p_text"))
            yield pa.RecordBatch.from_arrays([part.column("cls"), binary_rows(values, size).cast(pa.binary())], names=["cls", "shingles"])


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that stand together, several to a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(edge[-1]) if len(edge) else 0
        if held and (last or held[-1].column(key)[-1].as_py() != keys[0]):
            cut = last
            if held[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
                if cut:
                    yield pa.Table.from_batches([batch.slice(0, cut)])
            else:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def alike(sketch: np.ndarray, size: np.ndarray, row: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``others`` may reach the threshold with ``row``: sizes, then sketches.

    Of the bins that either set fills, the share that agrees is the similarity,
    give or take a standard deviation of sqrt(0.19 / bins) at the threshold; five
    of them are allowed for.
    """
    low, high = np.minimum(size[others], size[row]), np.maximum(size[others], size[row])
    near = others[low >= threshold * high]
    same = ((sketch[near] == sketch[row]) & (sketch[row] != 0)).sum(axis=1)
    bins = (sketch[near] | sketch[row]).astype(bool).sum(axis=1)
    return near[same >= bins * (threshold - 5 * np.sqrt(0.19 / np.maximum(bins, 1)))]


def _groups(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    keys = table.column(key).to_numpy()
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(edge, edge[1:], strict=False)


def near_duplicates(docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text", node: int = NODE) -> DataFrame:
    """Per document: ``_p_id``, ``_p_hash`` (of its text), ``n_shingles`` and ``comp``, the least id linked."""
    plain = docs.select(id_of(docs, key).alias("_p_id"), F.xxhash64(text_of(docs, text)).alias("_p_hash"), text_of(docs, text).alias("_p_text"))
    rows = save(plain.mapInArrow(_sketches, _SKETCH), "sketches")
    same_set = ["set_a", "set_b", "n_shingles"]
    # cls: number of the class; the first document by id stands for it
    classes = save(
        rows.where("n_shingles > 0")
        .groupBy(*same_set)
        .agg(F.min(F.struct("_p_id", "_p_hash")).alias("first"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
        .withColumn("cls", F.xxhash64(*same_set)),
        "classes",
    )
    search = _Search(plain, classes, threshold, node)
    search.trees(range(1), levels=1)
    dealt = search.trees(range(1, TREES), levels=LEVELS)
    if dealt is not None:
        search.across(dealt)
        remove(dealt)
    known = search.known
    first_of = classes.join(known, "cls").groupBy("comp").agg(F.min("first._p_id").alias("least"))
    of_class = save(classes.join(known, "cls").join(first_of, "comp").select(*same_set, F.col("least").alias("comp")), "linked-sets")
    remove(known)
    own = classes.select(*same_set, F.col("first._p_id").alias("own")).join(of_class, same_set, "left").select(*same_set, F.coalesce("comp", "own").alias("comp"))
    return rows.select("_p_id", "_p_hash", *same_set).join(own, same_set, "left").select("_p_id", "_p_hash", "n_shingles", F.coalesce("comp", "_p_id").alias("comp"))


def _blocks_of(n: Column, node: int) -> Column:
    """How many blocks of about half a node take ``n`` classes."""
    return F.ceil(n * 2 / node).cast("long")


class _Search:
    """The classes of a table and the components that were found among them so far."""

    def __init__(self, plain: DataFrame, classes: DataFrame, threshold: float, node: int):
        self.plain, self.classes, self.threshold, self.node = plain, classes, threshold, node
        self.spark = classes.sparkSession
        self.known = self.spark.createDataFrame([], "cls long, comp long")

    def _with_comp(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def _mixed(self, nodes: DataFrame) -> DataFrame:
        """Members of nodes with several components: ``n`` classes, ``most`` in one component, and one of them as ``anchor``."""
        # counts are made map-side, by component first; a node with one class or one component is done
        parts = nodes.groupBy("node", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", "cls").alias("h"), "cls")).alias("least"))
        count = parts.groupBy("node").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.min("least").alias("least"))
        return nodes.join(count.where("most < n").select("node", "n", "most", F.col("least.cls").alias("anchor")), "node")

    def trees(self, trees: range, levels: int) -> DataFrame | None:
        """Link within the nodes of some trees; of deeper ones, the members of nodes whose blocks have yet to meet, if any."""
        per_tree = 1 + 2 * (LEVELS - 1)
        token = lambda k: F.substring("paths", k * 8 + 1, 8)
        roots = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), token(t * per_tree)).alias("node")) for t in trees))
        nodes = self._with_comp(self.classes.select("cls", roots.alias("roots"))).select("cls", "comp", F.explode("roots").alias("n")).select("cls", "comp", "n.tree", "n.node")
        ready, tables, met = [], [], []
        for level in range(levels):
            mixed = save(self._mixed(nodes), "nodes")
            tables.append(mixed)
            ready.append(mixed.where(f"n <= {self.node}").select("node", "cls"))
            large = mixed.where(f"n > {self.node}")
            if not large.limit(1).count():
                break
            if level < levels - 1:
                # a component with a quarter of a node shares the next shingles too: its node is not split by branching
                whole = F.col("most") * 4 >= F.col("n")
                met.append(large.where(whole).select("node", "cls"))
                large = large.where(~whole)
                chosen = []
                for t in trees:
                    base = t * per_tree + 1 + 2 * level
                    chosen.append(F.when(F.col("tree") == t, F.array(token(base), token(base + 1))))
                deeper = large.join(self.classes.select("cls", "paths"), "cls")
                nodes = deeper.select("cls", "comp", "tree", "node", F.explode(F.coalesce(*chosen)).alias("token")).select("cls", "comp", "tree", F.xxhash64("node", "token").alias("node"))
                continue
            # random blocks, each with the node's anchor, so that a group of copies becomes one component
            blocks = _blocks_of(F.col("n"), self.node)
            own = large.select(F.xxhash64("node", F.pmod(F.xxhash64("cls", "node"), blocks)).alias("node"), "cls")
            anchors = large.where("cls = anchor").select("node", "cls", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
            ready.append(own.unionByName(anchors.select(F.xxhash64("node", "block").alias("node"), "cls")).distinct())
            met.append(large.select("node", "cls"))
        self._link(reduce(DataFrame.unionByName, ready))
        dealt = save(reduce(DataFrame.unionByName, met), "dealt") if met and levels > 1 else None
        if dealt is not None and not dealt.limit(1).count():
            remove(dealt)
            dealt = None
        for t in tables:
            remove(t)
        return dealt

    def across(self, dealt: DataFrame) -> None:
        """Compare each two blocks of the nodes that were dealt out and still hold several components.

        The classes of a node's largest component are not compared with each
        other: its blocks only meet the blocks of the others, and these each other.
        """
        members = save(self._mixed(self._with_comp(dealt)).select("node", "cls", "comp"), "mixed")
        sizes = members.groupBy("node", "comp").agg(F.count("*").alias("c"))
        facts = sizes.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"))
        facts = facts.select("node", F.col("top.comp").alias("top"), _blocks_of(F.col("top.c"), self.node).alias("p"), _blocks_of(F.col("n") - F.col("top.c"), self.node).alias("q"))
        both = members.join(facts, "node").withColumn("inner", F.col("comp") == F.col("top"))
        both = both.withColumn("block", F.pmod(F.xxhash64("cls", "node"), F.when(F.col("inner"), F.col("p")).otherwise(F.col("q"))) + F.when(F.col("inner"), F.col("q")).otherwise(0))
        # blocks 0 to q - 1 have the others, q to q + p - 1 the largest component
        met = F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("q")).otherwise(F.col("p") + F.col("q")) - 1)
        pairs = both.select("cls", "node", "block", F.explode(met).alias("other"))
        self._link(pairs.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "cls"))
        remove(members)

    def _link(self, members: DataFrame) -> None:
        """Confirm links among the classes of each node and join the components they connect."""
        parts, threshold = shuffle_partitions(self.spark), self.threshold
        # classes with a partner that sizes and sketches do not rule out
        rows = self._with_comp(self.classes.select("cls", F.col("n_shingles").alias("size"), "sketch"))
        full = members.join(rows, "cls").repartition(parts, "node").sortWithinPartitions("node", "cls")

        def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_group(batches, "node"):
                size, comp = table.column("size").to_numpy(), table.column("comp").to_numpy()
                sketch = np.frombuffer(buffer_of_binary(table.column("sketch").combine_chunks())[0], np.uint8).reshape(-1, BINS)
                keep = np.zeros(len(size), bool)
                for a, b in _groups(table, "node"):
                    for i in range(a, b - 1):
                        others = np.arange(i + 1, b)
                        found = alike(sketch, size, i, others[comp[others] != comp[i]], threshold)
                        if len(found):
                            keep[i] = keep[found] = True
                if keep.any():
                    yield from table.select(["node", "cls", "comp", "size", "sketch"]).filter(pa.array(keep)).to_batches()

        wanted = save(full.mapInArrow(promising, "node long, cls long, comp long, size long, sketch binary"), "promising")
        first = save(self.classes.join(wanted.select("cls").distinct(), "cls").select("cls", F.col("first._p_id").alias("_p_id"), F.col("first._p_hash").alias("_p_hash")), "sought")
        sought = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first  # three numbers a row
        # a class's text: rows that agree in id and text have one set, and any will do
        texts = self.plain.join(sought, ["_p_id", "_p_hash"]).select("cls", "_p_text")
        sets = texts.mapInArrow(_sets, "cls long, shingles binary").dropDuplicates(["cls"])
        armed = wanted.join(sets, "cls").repartition(parts, "node").sortWithinPartitions("node", "cls")

        def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_group(batches, "node"):
                size, cls, comp = (table.column(c).to_numpy() for c in ("size", "cls", "comp"))
                sketch = np.frombuffer(buffer_of_binary(table.column("sketch").combine_chunks())[0], np.uint8).reshape(-1, BINS)
                column = table.column("shingles")
                left, right = [], []
                for a, b in _groups(table, "node"):
                    sets = [np.frombuffer(column[i].as_py(), np.uint64) for i in range(a, b)]
                    group = comp[a:b].copy()
                    for i in range(a, b):
                        others = np.arange(a, i)
                        for j in alike(sketch, size, i, others[group[others - a] != group[i - a]], threshold):
                            if group[i - a] == group[j - a]:
                                continue
                            x, y = sets[i - a], sets[j - a]
                            shared = len(np.intersect1d(x, y, assume_unique=True))
                            if 100 * shared >= round(100 * threshold) * (len(x) + len(y) - shared):
                                left.append(cls[i])
                                right.append(cls[j])
                                group[group == group[i - a]] = group[j - a]
                if left:
                    yield pa.RecordBatch.from_pydict({"a": left, "b": right})

        links = save(armed.mapInArrow(confirmed, "a long, b long").distinct(), "links")
        remove(wanted)
        remove(first)
        edges = links.unionByName(self.known.select(F.col("cls").alias("a"), F.col("comp").alias("b")))
        before, self.known = self.known, save(components(edges).select(F.col("id").alias("cls"), "comp"), "linked")
        remove(links)
        remove(before)


def keep_first(docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near duplicates."""
    docs, names = aside(docs)
    back = {c: new for new, c in names.items()}
    key, text = back.get(key, key), back.get(text, text)
    found = near_duplicates(docs, threshold, key, text).where("comp <> _p_id").select("_p_id", "_p_hash").distinct()
    mine = (id_of(docs, key) == F.col("_p_id")) & (F.xxhash64(text_of(docs, text)) == F.col("_p_hash"))
    return restored(docs.join(found, mine, "left_anti"), names)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    null = F.col("_p_id") == F.lit((1 << 63) - 1)
    return found.select(F.when(~null, F.col("_p_id")).alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"), (F.col("_p_id") == F.col("comp")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
