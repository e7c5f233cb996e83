import random

import numpy as np
import pytest

from tests.llm.test_corpus_operators import distances, edited
from tilsim.llm import simhash


def zipfian(seed, n, size=3000):
    """Words of one vocabulary, drawn independently by Zipf's law."""
    rng = np.random.default_rng(0)
    words = np.array(["".join(rng.choice(list("abcdeghilmnoprstu"), 2 + k % 9)) for k in range(size)])
    share = 1 / np.arange(1, size + 1)
    return " ".join(words[np.random.default_rng(seed).choice(size, n, p=share / share.sum())])


@pytest.mark.parametrize("n", [20_000, 50_000, 100_000])
def test_unrelated_long_texts_stay_apart(n):
    d = distances([zipfian(i + 1, n) for i in range(4)])
    assert d[np.triu_indices(4, 1)].min() > simhash.DISTANCE + 10


@pytest.mark.parametrize("n", [49, 52, 300, 20_000])
def test_near_copies_of_any_length_meet(n):
    text = zipfian(random.Random(n).randrange(99), n)
    assert distances([text, edited(text, 1, 0.02)])[0, 1] <= simhash.DISTANCE


def test_unrelated_long_texts_are_kept(docs_of):
    rows = [(i, zipfian(i + 1, 50_000)) for i in range(4)]
    assert all(r["keep"] for r in simhash.near_duplicates(docs_of(rows)).collect())
