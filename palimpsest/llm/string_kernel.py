"""Gap-weighted subsequence kernel of order three over words.

phi_abc(w) sums decay ** span over all places where letters a, b, c stand in
this order within ``SPAN`` characters. Similarity is the cosine of phi. Against
a fixed list of landmarks only their own letter triples count, so the words of
a batch are matched by table lookups on shifted character arrays.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

DECAY = 0.6
SPAN = 6
HITS = 50_000
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def clean(word: bytes) -> bytes:
    """A word without the ASCII marks that may be put between its letters."""
    return word.translate(None, PUNCTUATION)


def phi(word: str) -> dict[int, float]:
    out: dict[int, float] = defaultdict(float)
    codes = list(map(ord, word))
    for a, b in GAPS:
        for i in range(len(codes) - a - b):
            out[codes[i] << 42 | codes[i + a] << 21 | codes[i + a + b]] += DECAY ** (a + b + 1)
    return dict(out)


def norm(features: dict[int, float]) -> float:
    return sum(v * v for v in features.values()) ** 0.5


def norms(text: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Norms of the words that begin at ``start`` in ``text``.

    ``distinct`` has the squared norm that holds where no letter repeats; only
    for other words are equal triples brought together, by sorting integers of
    word, triple and span.
    """
    square = distinct[words].copy()
    letters, text = np.unique(text, return_inverse=True)
    bits = max(1, int(len(letters) - 1).bit_length())
    owner = np.repeat(np.arange(len(words)), size[words])
    at = np.repeat(start[words] - np.cumsum(size[words]) + size[words], size[words]) + np.arange(len(owner))
    pairs = np.sort(owner * len(letters) + text[at])
    again = np.unique(pairs[1:][pairs[1:] == pairs[:-1]] // len(letters))
    most = max(1, min(20_000, 1 << max(0, 61 - 3 * bits)))
    for lo in range(0, len(again), most):
        some = words[again[lo : lo + most]]
        n = size[some]
        row = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = text[np.repeat(start[some], n) + place].astype(np.int64)
        left = n[row] - place
        keys = []
        for a, b in GAPS:
            i = np.flatnonzero(left > a + b)
            code = own[i] << 2 * bits | own[i + a] << bits | own[i + a + b]
            keys.append((row[i] << 3 * bits | code) << 2 | (a + b - 2))
        key = np.sort(np.concatenate(keys))
        group = key >> 2
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sums = np.add.reduceat(DECAY ** ((key & 3) + 3.0), new)
            square[again[lo : lo + most]] = np.bincount(group[new] >> 3 * bits, sums * sums, len(some))
    return np.sqrt(np.where(square > 0, square, 1.0))


class Landmarks:
    """Similarities of many words to a list of landmark words."""

    def __init__(self, words: list[str], floor: float):
        self.words, self.floor = words, floor
        own = [phi(w) for w in words]
        triples = sorted({t for f in own for t in f})
        self.triples = np.array(triples, np.int64)
        place = {t: k for k, t in enumerate(triples)}
        self.table = np.zeros((len(triples), len(words)))
        for j, f in enumerate(own):
            n = norm(f) or 1.0
            for t, v in f.items():
                self.table[place[t], j] = v / n
        self.most = self.table.max(axis=1) if len(words) else np.zeros(0)
        self.known = np.zeros(1 << 20, bool)
        self.known[self._slot(self.triples)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def gram(self) -> np.ndarray:
        return self.table.T @ self.table

    def similar(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that come near some landmark, and their rows.

        A similarity under the floor counts as 0, and so does one of a word
        shorter than three characters.
        """
        none = np.zeros(0, np.int64), np.zeros((0, len(self.words)))
        if not words or not self.words:
            return none
        text = np.frombuffer(b"\n".join(words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = text == 10
        owner = np.cumsum(stop)
        owner[stop] = -1
        size = np.bincount(owner[~stop], minlength=len(words))
        word_at, triple, weight = [], [], []
        for a, b in GAPS:
            n = len(text) - a - b
            if n <= 0:
                continue
            same = (owner[:n] == owner[a + b :]) & ~stop[:n]
            code = text[:n] << 42 | text[a : a + n] << 21 | text[a + b :]
            spot = np.flatnonzero(same & self.known[self._slot(code)])
            k = np.minimum(np.searchsorted(self.triples, code[spot]), len(self.triples) - 1)
            spot, k = spot[self.triples[k] == code[spot]], k[self.triples[k] == code[spot]]
            word_at.append(owner[spot])
            triple.append(k)
            weight.append(np.full(len(spot), DECAY ** (a + b + 1)))
        if not word_at:
            return none
        word_at, triple, weight = map(np.concatenate, (word_at, triple, weight))
        # no norm is under that of a word whose triples all differ
        least = np.zeros(len(words))
        for a, b in GAPS:
            least += np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b + 1))
        bound = np.bincount(word_at, weight * self.most[triple], len(words)) / np.sqrt(np.maximum(least, 1e-12))
        near = np.flatnonzero(bound >= self.floor)
        row = np.full(len(words), -1)
        row[near] = np.arange(len(near))
        use = row[word_at] >= 0
        order = np.argsort(row[word_at[use]], kind="stable")
        r, t, v = row[word_at[use]][order], triple[use][order], weight[use][order]
        first = np.searchsorted(r, np.arange(len(near) + 1))
        out = np.zeros((len(near), len(self.words)))
        lo = 0
        while lo < len(near):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + HITS, side="right")) - 1)
            part = slice(first[lo], first[hi])
            out[lo:hi] = np.add.reduceat(v[part, None] * self.table[t[part]], first[lo:hi] - first[lo])
            lo = hi
        out /= norms(text, np.cumsum(size + 1) - size - 1, size, near, least)[:, None]
        out[out < self.floor] = 0.0
        some = np.flatnonzero(out.any(axis=1))
        return near[some], out[some]
