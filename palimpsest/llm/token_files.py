"""Flat token-id files with 64-bit document offsets (operator 4).

``write`` deals documents into ranges of ascending id, and each task streams
one shard: ``shard-k.bin`` has the ids as little-endian unsigned integers,
16 bits wide where the vocabulary allows, ``shard-k.doc`` the 64-bit document
ids and ``shard-k.len`` the ids per document. The driver adds up one row per
shard; from these bases a second, small pass writes ``shard-k.idx``, the
unsigned 64-bit offsets of every document in the whole corpus. A task writes
under a name of its own and renames, so a lost executor's task can run again.

Cases: null texts are empty documents (the end id alone); null ids sort last
and come back as null; repeated rows are written as often as they occur; an
empty table gives a manifest without shards and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunk_tokens import tokenizer
from palimpsest.llm.common import NULL_ID, id_of, new_path, shuffle_partitions, text_of
from palimpsest.llm.textblocks import slices

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text") -> dict:
    """Write ``docs`` below ``path`` and return the manifest, also kept as JSON."""
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    parts = shuffle_partitions(spark)
    store, root = _open(path)
    store.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        k = TaskContext.get().partitionId()
        stem, mark = f"{base}/shard-{k:06d}", uuid.uuid4().hex[:8]
        total, docs_seen, lengths = 0, [], []
        with where.open_output_stream(f"{stem}.bin.{mark}") as out:
            for batch in batches:
                for part in slices(batch, "_p_text"):
                    ids, sizes = tokenizer(tokenizer_path).encode(part.column("_p_text"), end_id)
                    out.write(ids.astype(f"<u{width}").tobytes())
                    total += len(ids)
                    lengths.append(sizes.astype("<u8"))
                    docs_seen.append(part.column("_p_id").to_numpy(zero_copy_only=False).astype("<i8"))
        where.move(f"{stem}.bin.{mark}", f"{stem}.bin")
        n = sum(map(len, lengths))
        _put(where, f"{stem}.len", np.concatenate([*lengths, np.zeros(0, "<u8")]).tobytes())
        _put(where, f"{stem}.doc", np.concatenate([*docs_seen, np.zeros(0, "<i8")]).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [n], "ids": [total]})

    rows = (
        docs.select(id_of(docs, key).alias("_p_id"), text_of(docs, text).alias("_p_text"))
        .repartitionByRange(parts, "_p_id")
        .sortWithinPartitions("_p_id", "_p_text")
        .mapInArrow(shard, "shard long, docs long, ids long")
        .collect()  # one row for each shard
    )
    shards, ids, n = [], 0, 0
    for r in sorted(rows):
        if r.docs:
            shards.append({"shard": r.shard, "docs": r.docs, "ids": r.ids, "first_id": ids, "first_doc": n})
        ids, n = ids + r.ids, n + r.docs
    manifest = {"width": width, "end_id": end_id, "docs": n, "ids": ids, "shards": shards}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = shards[k]
                stem = f"{base}/shard-{s['shard']:06d}"
                with where.open_input_file(f"{stem}.len") as f:
                    sizes = np.frombuffer(f.read(), "<u8")
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]).astype("<u8") + np.uint64(s["first_id"])
                _put(where, f"{stem}.idx", offsets.astype("<u8").tobytes())
                yield pa.RecordBatch.from_pydict({"n": [len(sizes)]})

    if shards:
        spark.range(0, len(shards), 1, len(shards)).mapInArrow(index, "n long").collect()
    _put(store, f"{root}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def load(path: str) -> dict:
    store, root = _open(path)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _map(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """Memory map of a file; a store that has no maps is read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files alone; ``ids`` as 32-bit binary if asked for."""
    manifest = load(path)
    shards, width = manifest["shards"], manifest["width"]
    schema = READ_SCHEMA + (", ids binary" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                stem = f"{base}/shard-{shards[k]['shard']:06d}"
                ids = _map(store, f"{stem}.bin", f"<u{width}")
                offsets = np.asarray(_map(store, f"{stem}.idx", "<u8"))
                docs = np.asarray(_map(store, f"{stem}.doc", "<i8"))
                local = (offsets - offsets[0]).astype(np.int64)
                for a in range(0, len(docs), 2000):
                    b = min(a + 2000, len(docs))
                    wide = [ids[local[i] : local[i + 1]].astype("<u4") for i in range(a, b)]
                    out = {
                        "doc_id": pa.array(docs[a:b], mask=docs[a:b] == NULL_ID),
                        "start": pa.array(offsets[a:b].astype(np.int64)),
                        "n_tokens": pa.array(np.diff(local[a : b + 1])),
                        "ids_crc32": pa.array([zlib.crc32(w) for w in wide], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([w.tobytes() for w in wide], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(rows, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from palimpsest.llm.common import read as table

    path = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return read(spark, path)
