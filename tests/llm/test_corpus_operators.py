"""Operators over whole corpora, against brute force."""

import random
from math import lgamma, log

import numpy as np
import pytest

from tests.llm.conftest import prose
from tilsim.llm import ctw, media, simhash, substring


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = prose(rng.random(), 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rows, n = [], 0
    for i in range(150):
        base = prose(i, 40 + i)
        rows.append((n, base))
        n += 1
        for k in range(i % 4):
            rows.append((n, edited(base, (i, k).__hash__(), 0.01 * (k + 1)) if k else base))
            n += 1
    return rows


def distances(texts):
    m = np.frombuffer(b"".join(simhash.sketches(texts)), np.uint64).reshape(len(texts), -1)
    return np.bitwise_count(m[:, None, :] ^ m[None, :, :]).sum(axis=2)


def test_simhash_recall(spark, docs_of, corpus):
    d = distances([t for _, t in corpus])
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(corpus)).collect()}
    parent = list(range(len(corpus)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(a, b) for a in range(len(corpus)) for b in range(a) if d[a, b] <= simhash.DISTANCE]
    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    together = sum(out[a]["group_id"] == out[b]["group_id"] for a, b in near)
    assert together >= 0.95 * len(near) > 100
    assert all(root(i) == root(out[i]["group_id"]) for i in out)  # none that brute force parts
    exact = [(a, b) for a, b in near if d[a, b] <= simhash.EXACT]
    assert all(out[a]["group_id"] == out[b]["group_id"] for a, b in exact)
    assert sum(r["keep"] for r in out.values()) == len({r["group_id"] for r in out.values()})


def test_large_group_in_full(docs_of):
    base = prose(1, 120)
    rows = [(i, edited(base, i, 0.01)) for i in range(700)] + [(1000 + i, prose(5000 + i, 80)) for i in range(50)]
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert sum(out[i]["group_id"] == 0 for i in range(700)) >= 693
    assert all(out[1000 + i]["keep"] for i in range(50))


def test_thresholds():
    n = 1000
    pairs = np.array([[1.0, 5, 9]] * 7 + [[1e9, 2e9, 3e9]])
    t = simhash.allocate(pairs, n, 20)
    assert t[7] == -1 and sum(x + 1 for x in t) >= 21
    assert sum(x + 1 for x in simhash.allocate(pairs, n, 21)) >= 22
    with pytest.raises(ValueError):
        simhash.allocate(pairs, n, 30)


def test_probes_meet():
    rng = np.random.default_rng(2)
    order = rng.permutation(256)
    for away in range(simhash.EXACT + 1):
        a = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        bits = np.unpackbits(a, axis=1)
        bits[0, rng.choice(256, away, replace=False)] ^= 1
        m = np.concatenate([a, np.packbits(bits, axis=1)])
        keys, rows = simhash.probes(m, order, [2, 2, 2, 2, 2, 2, 2, 0])
        assert np.isin(keys[rows == 0], keys[rows == 1]).any()
    keys = np.sort(keys)
    assert (simhash._unpack_keys(simhash._pack_keys(keys)) == keys).all()
    ids = simhash._node(m)
    assert (simhash._unpack_ids(simhash._pack_ids(ids)) == ids).all()


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(20) if i % 7] + [(b"\x64", b"\x65"), (b"\x65", b"\x64")]
    got = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    for i in range(21):
        first = i
        while first > 0 and (first - 1) % 7:
            first -= 1
        if first != i:
            assert got[bytes([i])] == bytes([first])
    assert got[b"\x65"] == b"\x64"


def covered(texts, least):
    """Brute force: the characters of each text in a repeated window of least bytes."""
    seen = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        for i in range(len(raw) - least + 1):
            seen.setdefault(raw[i : i + least], []).append((k, i))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[k].update(range(i, i + least))
    return out


def test_substrings_against_brute_force(docs_of):
    rng = random.Random(9)
    shared = [prose(900 + i, 60) for i in range(4)]
    texts = []
    for i in range(40):
        t = prose(100 + i, 60 + i)
        if i % 3 == 0:
            words = t.split()
            at = rng.randrange(len(words))
            t = " ".join([*words[:at], rng.choice(shared), *words[at:]])
        texts.append(t)
    texts.append(edited(texts[20], 4, 0.02))
    truth = covered(texts, substring.LEAST)
    rows = substring.repeats(docs_of(list(enumerate(texts)))).collect()
    found = [set() for _ in texts]
    for r in rows:
        span = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(span.encode()) >= substring.LEAST - 6
        assert sum(span in t for t in texts) >= 2 and span in texts[r["first_doc_id"]]
        i = len(texts[r["doc_id"]][: r["start"]].encode())
        found[r["doc_id"]].update(range(i, i + len(span.encode())))
    assert sum(map(bool, truth)) > 12
    for k in range(len(texts)):
        assert found[k] <= truth[k] and bool(found[k]) == bool(truth[k])
        assert len(found[k]) >= 0.97 * len(truth[k])


def test_anchors_are_shared():
    rng = np.random.default_rng(4)
    for _ in range(30):
        same = rng.integers(97, 123, 199, dtype=np.uint8)
        a = np.concatenate([rng.integers(97, 123, rng.integers(0, 300), dtype=np.uint8), same, rng.integers(97, 123, 150, dtype=np.uint8)])
        b = np.concatenate([rng.integers(97, 123, rng.integers(0, 300), dtype=np.uint8), same, rng.integers(97, 123, 150, dtype=np.uint8)])
        assert set(substring.anchors(a)[1]) & set(substring.anchors(b)[1])


def brute_ctw(texts, depth):
    """Direct recursion over contexts as Python objects."""
    counts = {}
    for t in texts:
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
            own = kt(*counts[key])
            memo[key] = own if len(key[0]) == depth else float(np.logaddexp(own, sum(weighted(k) for k in kids[key])) + log(0.5))
        return memo[key]

    def bits(t):
        raw, total = b"\0" * depth + t, 0.0
        for i in range(depth, len(raw)):
            node = 1
            for bit in map(int, f"{raw[i]:08b}"):
                p = None
                for d in range(depth, -1, -1):
                    key = (raw[i - d : i], node)
                    n = counts[key]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    if p is None:
                        p = own
                    else:
                        w = np.exp(kt(*n) + log(0.5) - weighted(key))
                        p = w * own + (1 - w) * p
                total -= np.log2(p)
                node = node * 2 + bit
        return total

    return [bits(t) for t in texts]


def test_ctw_against_brute_force(docs_of):
    texts = ["abracadabra", "the cat sat on the mat", "", "abra", "ünïcode é", "the cat"]
    want = brute_ctw([t.encode() for t in texts], 3)
    got = {r["doc_id"]: r for r in ctw.score(docs_of(list(enumerate(texts))), depth=3, block_bytes=20).collect()}
    for i, bits in enumerate(want):
        assert abs(got[i]["bits"] - bits) < 0.01
    assert got[2]["bits_per_byte"] is None


def test_ctw_prefers_what_the_corpus_is_like(docs_of):
    rng = random.Random(3)
    rows = [(i, prose(i, 300)) for i in range(60)] + [(99, "".join(chr(rng.randrange(33, 127)) for _ in range(2000)))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(docs_of(rows), block_bytes=20_000).collect()}
    assert max(got[i] for i in range(60)) < 3 < got[99]


def test_grams_by_both_ways():
    texts = [b"hello world", b"", bytes(range(256)) * 3]
    dense = ctw.grams(texts, 4)
    old, ctw._DENSE = ctw._DENSE, 0
    try:
        sparse = ctw.grams([*texts], 4)
    finally:
        ctw._DENSE = old
    for a, b in zip(dense, sparse, strict=True):
        assert (a == b).all()


def test_media_round_trip(spark, tmp_path):
    import struct
    import zlib

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + random.Random(1).randbytes(5000)
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + random.Random(2).randbytes(3000)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 200, 300) + b"\x03" + random.Random(3).randbytes(900)
    html = b"<!DOCTYPE html><html lang='de'><head><meta charset='utf-8'><title> Hallo </title></head>" + b"<p>abc</p>" * 5000
    rows = [(1, bytearray(png)), (2, bytearray(wav)), (3, bytearray(jpeg)), (4, bytearray(html)), (5, None), (6, bytearray(b"")), (7, bytearray(png)), (7, bytearray(png)), (None, bytearray(zlib.compress(b"x" * 99)))]
    df = spark.createDataFrame(rows, "k bigint, p binary")
    out = media.media_columns(df, "k", "p", f"file://{tmp_path}/store")
    got = out.collect()
    by = {r["k"]: r for r in got}
    assert (by[1]["kind"], by[1]["width"], by[1]["height"], by[1]["channels"]) == ("png", 640, 480, 3)
    assert (by[2]["kind"], by[2]["channels"], by[2]["sample_rate"]) == ("wav", 2, 44100)
    assert (by[3]["kind"], by[3]["width"], by[3]["height"]) == ("jpeg", 300, 200)
    assert (by[4]["kind"], by[4]["lang"], by[4]["charset"], by[4]["title"]) == ("html", "de", "utf-8", "Hallo")
    assert by[5]["digest"] is None and by[6]["length"] == 0 and len(got) == 9
    assert len({(r["digest"], r["shard"], r["offset"]) for r in got if r["k"] in (1, 7)}) == 1
    back = media.fetch(out, "k").collect()
    assert all(r["intact"] in (True, None) for r in back)
    assert {r["k"]: r["payload"] for r in back if r["k"]} == {k: p for k, p in rows if k}
    import tarfile

    again = media.store(df.repartition(3), "k", "p", f"file://{tmp_path}/other")
    assert {(r["k"], r["digest"]) for r in again.collect()} == {(r["k"], r["digest"]) for r in got}
    assert len({(r["shard"], r["offset"]) for r in again.collect() if r["k"] in (1, 7)}) == 1
    names = [m for s in {r["shard"] for r in got if r["shard"]} for m in tarfile.open(s.removeprefix("file://")).getnames()]
    assert sorted(names) == sorted({r["digest"] for r in got if r["digest"]})
