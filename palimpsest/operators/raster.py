"""Raster blocks as rows: masks, pyramids, ink counts, PNG, phase correlation."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.operators.spatial import inside

RESAMPLING = {"topo": "nearest", "orthophotoquad": "cubic"}


def resampling_for(kind: str) -> str:
    if kind not in RESAMPLING:
        raise ValueError(f"no resampling for {kind!r}")
    return RESAMPLING[kind]


def crop_mask(rings: list[np.ndarray], transform: list[float], width: int, height: int) -> np.ndarray:
    """255 where a pixel's centre is inside; an empty mask is an error."""
    x = transform[2] + transform[0] * (np.arange(width) + 0.5)
    y = transform[5] + transform[4] * (np.arange(height) + 0.5)
    hit = np.zeros((height, width), bool)
    for ring in rings:
        hit ^= inside(x[None, :], y[:, None], ring)
    if not hit.any():
        raise ValueError("the crop holds no pixel")
    return np.where(hit, 255, 0).astype(np.uint8)


def apply_alpha(bands: np.ndarray, coverage: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bands with an alpha band; colour is zero where nothing shows."""
    alpha = np.where((coverage > 0) & (mask > 0), 255, 0).astype(np.uint8)
    return np.concatenate([np.where(alpha > 0, bands, 0).astype(np.uint8), alpha[None]])


def decimate(block: np.ndarray, factor: int) -> np.ndarray:
    """Means of colour over shown pixels; alpha by its nearest pixel."""
    colour, alpha = block[:-1].astype(float), block[-1]
    bands, h, w = colour.shape
    cut = colour.reshape(bands, h // factor, factor, w // factor, factor)
    shown = (alpha > 0).reshape(h // factor, factor, w // factor, factor)
    n = shown.sum(axis=(1, 3))
    mean = np.where(n > 0, (cut * shown).sum(axis=(2, 4)) / np.maximum(n, 1), 0)
    near = alpha[factor // 2 :: factor, factor // 2 :: factor]
    return np.concatenate([np.where(near > 0, np.rint(mean), 0).astype(np.uint8), near[None]])


def block_counts(block: np.ndarray) -> tuple[int, int]:
    """Opaque pixels, and those of them with some channel under 128."""
    shown = block[-1] > 0
    return int(shown.sum()), int((shown & (block[:-1].min(axis=0) < 128)).sum())


def png(block: np.ndarray) -> bytes:
    """PNG of a grey+alpha or RGBA block, always the same bytes."""
    bands, h, w = block.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), block.transpose(1, 2, 0).reshape(h, -1)], axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


TILE = "z int, x long, y long, png binary, opaque long, ink long, bytes long"


def cut_pyramid(blocks: DataFrame, top: int, bottom: int, bands: int, size: int = 256) -> DataFrame:
    """Tiles of every zoom from rows (z, x, y, data) at the top zoom.

    Each coarser zoom groups four tiles of the one above, never more, so no
    group grows with the raster.
    """

    def encode(frames):
        for f in frames:
            out = []
            for z, x, y, data in zip(f.z, f.x, f.y, f.data, strict=True):
                b = np.frombuffer(data, np.uint8).reshape(bands, size, size)
                image = png(b)
                out.append((z, x, y, image, *block_counts(b), len(image)))
            yield pd.DataFrame(out, columns=["z", "x", "y", "png", "opaque", "ink", "bytes"])

    def parent(key, f):
        z, x, y = key
        whole = np.zeros((bands, 2 * size, 2 * size), np.uint8)
        for cx, cy, data in zip(f.x, f.y, f.data, strict=True):
            r, c = int(cy % 2) * size, int(cx % 2) * size
            whole[:, r : r + size, c : c + size] = np.frombuffer(data, np.uint8).reshape(bands, size, size)
        return pd.DataFrame([(z, x, y, decimate(whole, 2).tobytes())], columns=["z", "x", "y", "data"])

    level = blocks.select("z", "x", "y", "data")
    out = level.mapInPandas(encode, TILE)
    for z in range(top - 1, bottom - 1, -1):
        level = level.groupBy(F.lit(z).alias("pz"), F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py")).applyInPandas(parent, "z int, x long, y long, data binary")
        out = out.unionByName(level.mapInPandas(encode, TILE))
    return out


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), F.count_if(F.col("opaque") == 0).alias("transparent"), F.sum("opaque").alias("opaque_px"), F.sum("ink").alias("ink_px"), F.sum("bytes").alias("bytes"))


def phase_shift(a: np.ndarray, b: np.ndarray, apart: int = 3) -> tuple[float, float, float]:
    """Row and column shift of b against a, and first peak over the second."""
    h, w = a.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    fa, fb = (np.fft.fft2((m - m.mean()) * window) for m in (a, b))
    cross = fb * np.conj(fa)
    surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)

    def refine(left, mid, right):
        bend = left - 2 * mid + right
        return 0.0 if bend == 0 else (left - right) / (2 * bend)

    dr = refine(surface[r - 1, c], surface[r, c], surface[(r + 1) % h, c])
    dc = refine(surface[r, c - 1], surface[r, c], surface[r, (c + 1) % w])
    rows, cols = np.abs((np.arange(h) - r + h // 2) % h - h // 2), np.abs((np.arange(w) - c + w // 2) % w - w // 2)
    rest = np.where((rows[:, None] <= apart) & (cols[None, :] <= apart), -np.inf, surface)
    second = max(float(rest.max()), 1e-12)
    wrap = lambda v, n: v - n if v > n / 2 else v
    return float(wrap(r + dr, h)), float(wrap(c + dc, w)), float(surface[r, c] / second)


@pandas_udf(StructType([StructField(n, DoubleType()) for n in ("dy", "dx", "ratio")]))
def phase_correlation(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Shift between two flattened square patches."""
    out = []
    for p, q in zip(a, b, strict=True):
        n = int(len(p) ** 0.5)
        out.append(phase_shift(np.array(p, float).reshape(n, n), np.array(q, float).reshape(n, n)))
    return pd.DataFrame(out, columns=["dy", "dx", "ratio"])


def ground_offset(df: DataFrame, metres: float, least_ratio: float = 2.0) -> DataFrame:
    """East and north metres of a shift; null where the peak is not distinct."""
    k = F.cos(F.radians("lat")) * metres
    clear = F.col("ratio") >= least_ratio
    return df.withColumns({"east_m": F.when(clear, F.col("dx") * k), "north_m": F.when(clear, -F.col("dy") * k)})
