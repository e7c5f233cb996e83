"""Repeated substrings against brute force, place by place."""

import random

import pytest

from tests.llm.conftest import prose
from tests.llm.test_corpus_operators import edited
from tilsim.llm import substring


def brute_force(rows, least):
    """(id, start, length, occurrences, least id) of every maximal place."""
    texts = sorted({t for _, t in rows if t})
    count = {t: [i for i, x in rows if x == t] for t in texts}
    places = {}
    for k, t in enumerate(texts):
        for s in range(len(t)):
            e, size = s, 0
            while e < len(t) and size < least:
                size += len(t[e].encode())
                e += 1
            if size >= least:
                places.setdefault(t[s:e], []).append((k, s, e))
    spans = set()
    for owners in places.values():
        for k, s, e in owners:
            ends = []
            for j, u, v in owners:
                if (j, u) == (k, s) and len(count[texts[k]]) == 1:
                    continue
                a, b = texts[k], texts[j]
                n, most = 0, min(len(a) - e, len(b) - v)
                while n < most:  # the longest that both have from here on
                    mid = (n + most + 1) // 2
                    if a[e + n : e + mid] == b[v + n : v + mid]:
                        n = mid
                    else:
                        most = mid - 1
                ends.append(e + n)
            if ends:
                spans.add((k, s, max(ends)))
    out = []
    for k, s, e in spans:
        if not any(j == k and (u, v) != (s, e) and u <= s and e <= v for j, u, v in spans):
            part = texts[k][s:e]
            n, ids = 0, []
            for t in texts:
                at = t.find(part)
                found = 0
                while at >= 0:
                    found, at = found + 1, t.find(part, at + 1)
                if found:
                    n += found * len(count[t])
                    ids += count[t]
            first = min((i for i in ids if i is not None), default=None)
            out += [(i, s, e - s, n, first) for i in count[texts[k]]]
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(900 + i, 60) for i in range(3)] + ["ü–" * 150, "ab" * 170, prose(7, 90).replace("e", "é")]
    texts = []
    for i in range(26):
        words = prose(100 + i, 30 + i).split()
        for _ in range(i % 3):
            at = rng.randrange(len(words))
            part = rng.choice(shared)
            a, b = sorted(rng.choices(range(len(part)), k=2))
            words[at:at] = [part if rng.random() < 0.5 else part[a:b]]
        texts.append(" ".join(words))
    base = prose(1, 70)
    texts += [edited(base, k, 0.03) for k in range(12)] + [base, base, base + " " + shared[0], shared[0], shared[0]]
    texts += ["x" * k for k in (180, 201, 260, 261)] + [shared[5][k:] for k in range(3)] + ["", None]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    ids[3] = ids[5] = None
    ids[7] = ids[8]
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "group"), [(1, substring.GROUP), (2, 800), (3, 0)])
def test_every_place(docs_of, seed, group):
    rows = corpus(seed)
    want = brute_force(rows, substring.LEAST)
    got = [(r["doc_id"], r["start"], r["length"], r["n_occurrences"], r["first_doc_id"]) for r in substring.repeats(docs_of(rows), group=group).collect()]
    assert len(want) > 40
    assert sorted(got, key=repr) == want


def test_equal_substrings_have_one_id(docs_of):
    rows = corpus(4)
    texts = {i: t for i, t in rows if i is not None}
    seen = {}
    for group in (substring.GROUP, 2000):
        for r in substring.repeats(docs_of(rows), group=group).collect():
            if [i for i, _ in rows].count(r["doc_id"]) == 1:
                seen.setdefault(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]], set()).add(r["repeat_id"])
    assert len(seen) > 20 and all(len(ids) == 1 for ids in seen.values())
