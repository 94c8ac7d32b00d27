"""Exact tokenisation of whole texts by way of their distinct chunks.

A text is cut only where the public tokenizers are certain to start a new
piece: before a space or line feed that follows a printable character, and
between an ASCII letter and a full stop or comma. The ids of a text are then
the ids of its chunks end to end, and each worker asks the tokenizers library
about a chunk once. Chunks of plain letters go straight to the tokenizer's
merge model; all others take its whole normalise, split and merge path.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from palimpsest.llm.textblocks import buffer_of, encode_runs

# Last bytes of UTF-8 white space beyond ASCII; after them no cut is made.
_WIDE_SPACE_ENDS = [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
_SAFE_BEFORE = np.zeros(256, bool)
_SAFE_BEFORE[0x21:0x7F] = True
_SAFE_BEFORE[0x80:0x100] = True
_SAFE_BEFORE[_WIDE_SPACE_ENDS] = False
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
# Letters whose composed form and single lower case are stable.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkTokenizer:
    """Token ids of texts, with a bounded memory of chunks already seen."""

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.remember = remember
        self.letters = _byte_letters()
        self.lowers = self.whole.normalizer is not None and self.whole.normalizer.normalize_str("A") == "a"
        self.drops_space = not self.whole.encode(" ", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat, self.n_flat = np.empty(1 << 16, np.uint32), 0
        self.begin = np.zeros(1 << 16, np.int64)

    def _ids(self, chunk: str) -> list[int]:
        if _PLAIN.match(chunk):
            if self.lowers:
                chunk = chunk.lower()
            if self.drops_space:
                chunk = chunk.lstrip(" ")
            return [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        return self.whole.encode(chunk, add_special_tokens=False).ids

    def _index(self, values: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.remember:
            self._forget()
        out = np.empty(len(values), np.int64)
        seen = self.seen
        for k, v in enumerate(values):
            at = seen.get(v)
            if at is None:
                at = seen[v] = len(seen)
                ids = self._ids(v.decode())
                end = self.n_flat + len(ids)
                if end > len(self.flat):
                    self.flat = np.resize(self.flat, max(2 * len(self.flat), end))
                if at + 2 > len(self.begin):
                    self.begin = np.resize(self.begin, 2 * len(self.begin))
                self.flat[self.n_flat : end] = ids
                self.n_flat = self.begin[at + 1] = end
            out[k] = at
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text closed by ``end_id``, and ids per text."""
        raw, at = buffer_of(texts)
        n = len(at) - 1
        if not len(raw):
            return np.full(n, end_id, np.uint32), np.ones(n, np.int64)
        cut = np.zeros(len(raw), bool)
        cut[1:] = (_BREAK[raw[1:]] & _SAFE_BEFORE[raw[:-1]]) | (_STOP[raw[1:]] & _LETTER[raw[:-1]])
        cut[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        codes, values = encode_runs(raw, starts)
        index = self._index(values.to_pylist())
        first, size = self.begin[index], self.begin[index + 1] - self.begin[index]
        sizes = size[codes]
        at_chunk = np.searchsorted(starts, at)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        per_text = ends[at_chunk[1:]] - ends[at_chunk[:-1]]
        # gather: position in the memory of every id, one after the other
        take = np.repeat(first[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        ids = self.flat[take]
        return np.insert(ids, np.cumsum(per_text), end_id).astype(np.uint32), per_text + 1


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]
