"""Context-tree weighting with the own fold left out, against direct recursion."""

import random
from math import lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tilsim.llm import ctw
from tilsim.llm.common import pieces, text_bytes


def brute_force(own, others, depth):
    """Bits of a text under the counts of other texts, one context and decision at a time."""
    counts = {}
    for t in others:
        raw = b"\0" * depth + t
        for i in range(depth, len(raw)):
            node = 1
            for bit in map(int, f"{raw[i]:08b}"):
                for d in range(depth + 1):
                    counts.setdefault((raw[i - d : i], node), [0, 0])[bit] += 1
                node = node * 2 + bit
    kids = {}
    for c, v in counts:
        if c:
            kids.setdefault((c[1:], v), []).append((c, v))
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)
    memo = {}

    def weighted(key):
        if key not in memo:
            e = kt(*counts[key])
            memo[key] = e if len(key[0]) == depth else float(np.logaddexp(e, sum(weighted(k) for k in kids[key])) + log(0.5))
        return memo[key]

    raw, total = b"\0" * depth + own, 0.0
    for i in range(depth, len(raw)):
        node = 1
        for bit in map(int, f"{raw[i]:08b}"):
            p = 0.5
            for d in range(depth + 1):  # from the root down: where a context ends, what is above it decides
                key = (raw[i - d : i], node)
                if key not in counts:
                    break
                deepest = d
            else:
                deepest = depth
            if (b"", node) in counts:
                for d in range(deepest, -1, -1):
                    key = (raw[i - d : i], node)
                    n = counts[key]
                    e = (n[bit] + 0.5) / (sum(n) + 1)
                    share = 1.0 if d == depth else np.exp(kt(*n) + log(0.5) - weighted(key))
                    p = e if d == deepest else share * e + (1 - share) * p
            total -= np.log2(p)
            node = node * 2 + bit
    return total


@pytest.mark.parametrize(("depth", "folds", "fan"), [(3, 3, 64), (2, 2, 2), (4, 4, 3)])
def test_held_out_scores(docs_of, depth, folds, fan):
    texts = ["abracadabra", "the cat sat on the mat", "", "abra", "ünïcode é", "the cat", "the cat", "cat on the mat sat", "zzz"]
    rows = [(i if i != 6 else 5, t) for i, t in enumerate(texts)] + [(None, "the hat"), (None, None)]
    docs = docs_of(rows)
    blocks = folds * pieces(text_bytes(docs), 20 * folds)
    text = F.coalesce("text", F.lit(""))
    fold = {(r["doc_id"], r["t"]): r["f"] for r in docs.select("doc_id", text.alias("t"), (F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)) % folds).alias("f")).collect()}
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["bits"]) for r in ctw.score(docs, depth=depth, folds=folds, block_bytes=20, fan=fan).collect()))
    want = []
    for i, t in ((i, t or "") for i, t in rows):
        others = [(x or "").encode() for j, x in rows if fold[j, x or ""] != fold[i, t]]
        want.append((i is None, i or 0, len(t.encode()), brute_force(t.encode(), others, depth)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01, (a, b)


def test_what_stands_elsewhere_too_costs_less(docs_of):
    rng = random.Random(1)
    once = [(i, prose(i, 120)) for i in range(80)]
    twice = [(100 + i, prose(500 + i // 2, 120)) for i in range(40)]
    docs = docs_of(rng.sample(once + twice, 120))
    got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(docs, depth=6, folds=4, block_bytes=4000).collect()}
    low = np.quantile([got[i] for i, _ in once], 0.1)
    caught = np.mean([got[i] < low for i, _ in twice])
    assert caught > 0.35  # chance: 0.1; a quarter of the copies share a fold


def test_one_row_alone(docs_of):
    r = ctw.score(docs_of([(1, "abc")]), folds=4).first()
    assert (r["n_bytes"], r["bits"], r["bits_per_byte"]) == (3, 24.0, 8.0)
