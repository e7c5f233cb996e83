import random

import numpy as np

from tilsim.llm import substring


def test_suffixes_equal_copies():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90))) for _ in range(12)] + [b"ab" * 60, b"ab" * 41 + b"c", b"ab" * 60]
    row = np.array([i for i, t in enumerate(texts) for _ in t])
    off = np.array([k for t in texts for k in range(len(t))])
    copies = substring.Copies([texts[i][k:] for i, k in zip(row, off, strict=True)])
    places = substring.Suffixes(texts, row, off)
    left = [texts[i][:k][::-1] for i, k in zip(row, off, strict=True)]
    a, b = substring.tree(copies, left, 20), substring.tree(places, left, 20)
    assert a[1] == b[1] and (a[0] == b[0]).all() and a[0].shape[1] > 100


def test_one_repeated_word_of_a_megabyte(docs_of):
    text = "For " * 262_144
    rows = substring.repeats(docs_of([(1, text), (2, text[: len(text) // 2] + "end")])).collect()
    n = len(text)
    assert {(r["start"], r["length"]) for r in rows if r["doc_id"] == 1} == {(0, n - 4), (4, n - 4)}
    spans = [(r["start"], r["start"] + r["length"]) for r in rows if r["doc_id"] == 2]
    assert min(s for s, _ in spans) == 0 and max(e for _, e in spans) == n // 2
