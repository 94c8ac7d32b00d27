"""Unigram subword lattices: marginal likelihood and expected piece counts.

A word is a space mark and its characters; every way to cut it into pieces of
the vocabulary is a path, and its probability is the product of its pieces'.
Any character can also be spelled in bytes, so no word is impossible. Words of
one length are treated together: substrings are looked up by rolling hashes,
and the forward and backward recursions run in log space over all words of a
batch at once.
"""

from __future__ import annotations

import numpy as np

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file that can stand in a word, and first weights.

    The file's scores are minus the rank of a piece; by Zipf's law the weight of
    a rank is about one over it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) and MARK not in piece[1:]:
            pieces.append(piece)
            weights.append(1 / (10 - model.get_score(k)))
    w = np.array(weights)
    return pieces, w / w.sum()


class Lattice:
    """``weights``: probabilities of the pieces; they and the end share what bytes leave."""

    def __init__(self, pieces: list[str], weights: np.ndarray, end: float, byte_mass: float = 1e-4):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        with np.errstate(divide="ignore"):
            self.log = np.log(weights * (1 - byte_mass) * (1 - end))
        self.byte = np.log(byte_mass / 256 * (1 - end))
        self.end = float(np.log(end)) if end > 0 else float("-inf")
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest + 1, _BASE)]))
            codes = [self._hash(p) for p in pieces]
        self.slot_hash = np.zeros(1 << _SLOTS, np.uint64)
        self.slot_piece = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for k, h in enumerate(codes):
            at, tries = int(h >> np.uint64(64 - _SLOTS)), 1
            while self.slot_piece[at] >= 0:
                at, tries = (at + 1) % (1 << _SLOTS), tries + 1
            self.slot_piece[at], self.slot_hash[at] = k, h
            self.probes = max(self.probes, tries)
        self.by_text = {p: k for k, p in enumerate(pieces)}

    def _hash(self, text: str) -> np.uint64:
        h = np.uint64(0)
        for c in text:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return h * _BASE

    def _find(self, h: np.ndarray) -> np.ndarray:
        h = h * _BASE
        at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.probes):
            hit = (self.slot_hash[at] == h) & (self.slot_piece[at] >= 0)
            out[hit] = self.slot_piece[at[hit]]
            at = (at + 1) & ((1 << _SLOTS) - 1)
        return out

    def _arcs(self, codes: np.ndarray) -> tuple[list, np.ndarray]:
        """For words of one length: arcs (from, to, rows, pieces) and byte costs."""
        rows, n = codes.shape
        prefix = np.zeros((n + 1, rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                prefix[j + 1] = prefix[j] * _BASE + (codes[:, j] + np.uint64(1))
            arcs = []
            for j in range(1, n + 1):
                for i in range(max(0, j - self.longest), j):
                    piece = self._find(prefix[j] - prefix[i] * self.power[j - i])
                    at = np.flatnonzero(piece >= 0)
                    if len(at):
                        arcs.append((i, j, at, piece[at]))
        size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        return arcs, size * self.byte

    def _forward(self, arcs: list, spelled: np.ndarray) -> np.ndarray:
        rows, n = spelled.shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        k = 0
        for j in range(1, n + 1):
            alpha[j] = alpha[j - 1] + spelled[:, j - 1]
            while k < len(arcs) and arcs[k][1] == j:
                i, _, at, piece = arcs[k]
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + self.log[piece])
                k += 1
        return alpha

    def _batches(self, words: list[str], most: int = 1 << 17):
        """Rows of equal-length words, about ``most`` characters at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(size, kind="stable")
        k = 0
        while k < len(order):
            n = int(size[order[k]])
            end = min(int(np.searchsorted(size[order], n, "right")), k + max(1, most // n))
            rows = order[k:end]
            text = "".join(MARK + words[r] for r in rows)
            yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), n).astype(np.uint64)
            k = end

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for rows, codes in self._batches(words):
            if codes.shape[1] > 200:
                for r in rows:
                    out[r] = self._long(words[r])
            else:
                out[rows] = self._forward(*self._arcs(codes))[-1]
        return out

    def _long(self, word: str) -> float:
        """One long word: the same recursion with only the last few sums held."""
        text = MARK + word
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            total = alpha[-1] + len(text[j - 1].encode("utf-8", "surrogatepass")) * self.byte
            for i in range(max(0, j - self.longest), j):
                k = self.by_text.get(text[i:j])
                if k is not None:
                    total = np.logaddexp(total, alpha[i - j] + self.log[k])
            alpha.append(float(total))
            if len(alpha) > self.longest + 1:
                del alpha[0]
        return alpha[-1]

    def _long_uses(self, word: str, weight: float, out: np.ndarray) -> None:
        """Adds the expected uses in one long word, with the sums of all its positions held."""
        text = MARK + word
        n = len(text)
        spelled = [len(c.encode("utf-8", "surrogatepass")) * self.byte for c in text]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        for j in range(1, n + 1):
            alpha[j] = alpha[j - 1] + spelled[j - 1]
            for i in range(max(0, j - self.longest), j):
                k = self.by_text.get(text[i:j])
                if k is not None:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.log[k])
        for j in range(n, 0, -1):
            for i in range(max(0, j - self.longest), j):
                k = self.by_text.get(text[i:j])
                if k is not None:
                    step = self.log[k] + beta[j]
                    out[k] += np.exp(alpha[i] + step - alpha[n]) * weight
                    beta[i] = np.logaddexp(beta[i], step)
            beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + spelled[j - 1])

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words seen ``counts`` times."""
        out = np.zeros(len(self.pieces))
        for rows, codes in self._batches(words):
            if codes.shape[1] > 200:
                for r in rows:
                    self._long_uses(words[r], counts[r], out)
                continue
            arcs, spelled = self._arcs(codes)
            alpha = self._forward(arcs, spelled)
            n = codes.shape[1]
            beta = np.full((n + 1, len(rows)), -np.inf)
            beta[n] = 0
            k = len(arcs) - 1
            weight = counts[rows]
            for j in range(n, 0, -1):
                while k >= 0 and arcs[k][1] == j:
                    i, _, at, piece = arcs[k]
                    step = self.log[piece] + beta[j, at]
                    use = np.exp(alpha[i, at] + step - alpha[n, at]) * weight[at]
                    out += np.bincount(piece, use, len(out))
                    beta[i, at] = np.logaddexp(beta[i, at], step)
                    k -= 1
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + spelled[:, j - 1])
        return out
