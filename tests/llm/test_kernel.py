"""The string kernel against its definition, word by word."""

import random

import numpy as np
from palimpsest.llm.string_kernel import Landmarks, norm, phi


def test_similarities_equal_definition():
    r = random.Random(1)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 12))) for _ in range(2000)] + ["x" * 400, "abc", "ab", ""]
    marks = Landmarks([w for w in words[:60] if len(w) > 4], 0.3)
    near, rows = marks.similar([w.encode() for w in words])
    got = np.zeros((len(words), len(marks.words)))
    got[near] = rows
    own = [phi(w) for w in marks.words]
    for word, row in zip(words, got, strict=True):
        f = phi(word)
        want = [sum(v * g.get(t, 0.0) for t, v in f.items()) / ((norm(f) or 1.0) * norm(g)) for g in own]
        np.testing.assert_allclose(row, np.where(np.array(want) < 0.3, 0.0, want), atol=1e-9)
