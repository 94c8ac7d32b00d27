"""Sinks: staged files, index CSV, tile trees, verified copies. Two runs give the same bytes."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame

from palimpsest.operators.integrity import EngineError


def staged(path: str, data: bytes) -> bool:
    """Write beside the target, then rename; false if the target already holds the bytes."""
    target = Path(path)
    if target.exists() and target.read_bytes() == data:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".staged")
    with part.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, target)
    return True


def write_json(path: str, document: object) -> bool:
    return staged(path, (json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def write_index(df: DataFrame, columns: list[str], order: list, path: str) -> None:
    """One ordered CSV with a fixed header."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_report(path: str, lines: list[str]) -> bool:
    return staged(path, ("\n".join(lines) + "\n").encode())


def write_tiles(tiles: DataFrame, root: str) -> None:
    """``z/x/y.png`` below a folder that driver and executors share."""

    def put(rows) -> None:
        for r in rows:
            staged(f"{root}/{r.z}/{r.x}/{r.y}.png", bytes(r.png))

    tiles.select("z", "x", "y", "png").foreachPartition(put)


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def publish_file(source: str, target: str) -> None:
    """Content-addressed: a link if the store allows, else an exclusive copy."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.link(source, target)
    except FileExistsError:
        if sha256(source) != sha256(target):
            raise EngineError("archive", f"other bytes at {target}") from None
    except OSError:
        with open(source, "rb") as a, open(target, "xb") as b:
            shutil.copyfileobj(a, b)


def copy_verified(source: str, target: str, digest: str) -> bool:
    """False if the target has the bytes; other bytes there or in the source are errors."""
    if os.path.exists(target):
        if sha256(target) != digest:
            raise EngineError("archive", f"other bytes at {target}")
        return False
    if sha256(source) != digest:
        raise EngineError("archive", f"{source} has changed")
    with open(source, "rb") as f:
        staged(target, f.read())
    return True


def backup(rows: list[dict], raw: str, store: str) -> str:
    """Copy every receipted file into the store, with a manifest named by its hash."""
    for r in rows:
        copy_verified(f"{raw}/{r['raw_path']}", f"{store}/objects/sha256/{r['sha256'][:2]}/{r['sha256']}", r["sha256"])
    text = json.dumps(sorted(rows, key=lambda r: r["raw_path"]), sort_keys=True).encode()
    name = f"{store}/manifests/{hashlib.sha256(text).hexdigest()}.json"
    staged(name, text)
    return name


def restore(manifest: str, store: str, raw: str) -> int:
    with open(manifest) as f:
        return sum(copy_verified(f"{store}/objects/sha256/{r['sha256'][:2]}/{r['sha256']}", f"{raw}/{r['raw_path']}", r["sha256"]) for r in json.load(f))


def swap(staging: str, public: str) -> None:
    """Put a staged folder in place of the public one, and back if that fails."""
    old = public + ".old"
    shutil.rmtree(old, ignore_errors=True)
    had = os.path.exists(public)
    if had:
        os.rename(public, old)
    try:
        os.rename(staging, public)
    except OSError:
        if had:
            os.rename(old, public)
        raise
    shutil.rmtree(old, ignore_errors=True)
