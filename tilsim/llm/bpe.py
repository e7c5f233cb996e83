"""Byte-level BPE over a given vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are whole
entries of it. The others are merged from their bytes: a doubly linked list of parts and
a heap of the adjacent pairs by rank, so a word of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of this vocabulary, for the ``regex`` module.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ``re``, on texts without a character that it would class otherwise.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Beyond so many pre-tokens a worker forgets the ones it has at hand.
KEPT_WORDS = 300_000
#: Texts that a worker splits into pre-tokens at once.
SLICE = 256

_M = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return rng.integers(0, _M, 257, dtype=np.uint64) | np.uint64(1), np.array([0x9E3779B97F4A7C15], np.uint64)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, all at once."""
    if not words:
        return np.zeros(0, np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    table, base = _powers()
    starts = np.cumsum(n) - n
    at = np.arange(len(data), dtype=np.int64) - np.repeat(starts, n)
    with np.errstate(over="ignore"):
        longest = int(n.max(initial=0))
        power = np.cumprod(np.full(longest + 1, base[0], np.uint64))
        terms = _mix(table[data] + np.uint64(0)) * power[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        return _mix(sums[starts + n] - sums[starts] + n.astype(np.uint64) * table[256])


class PerfectHash:
    """Hash and displace: buckets, largest first, each get the first seed that sends
    their keys to free slots. The table has exactly as many slots as keys."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        h = hash_words(words)
        if len(np.unique(h)) != self.n:
            raise ValueError("two entries of the vocabulary have one hash")
        self.buckets = max(1, self.n // 3)
        self.seeds = np.zeros(self.buckets, np.uint64)
        self.slots = np.full(self.n, -1, np.int64)
        where = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(where, minlength=self.buckets))[:-1])
        free = np.ones(self.n, bool)
        singles = []
        for g in sorted((g for g in groups if len(g)), key=len, reverse=True):
            if len(g) == 1:
                singles.append(g[0])
                continue
            first, width = 1, 32
            while True:
                tried = np.arange(first, first + width, dtype=np.uint64)
                to = self._slot(h[g][None, :], tried[:, None])
                good = free[to].all(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(to[k].tolist())) == len(g):
                        break
                else:
                    first, width = first + width, min(4096, width * 4)
                    continue
                break
            self.seeds[where[g[0]]] = tried[k]
            free[to[k]], self.slots[to[k]] = False, g
        for k, slot in zip(singles, np.flatnonzero(free), strict=True):  # the top bit marks a slot given outright
            self.seeds[where[k]] = np.uint64(slot) | np.uint64(1 << 63)
            self.slots[slot] = k

    def _slot(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h ^ (seed * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(max(1, self.n))).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place each word would have; whether it is that word is for the caller."""
        if not self.n or not words:
            return np.full(len(words), -1, np.int64)
        h = hash_words(words)
        seed = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        given = (seed >> np.uint64(63)) > 0
        slot = np.where(given, (seed & np.uint64((1 << 63) - 1)).astype(np.int64), self._slot(h, seed))
        return self.slots[slot]


#: Bits of a place in a heap entry; a pre-token is shorter than 2 ** _PLACE bytes.
_PLACE = 32


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.words = [w for w, _ in pairs]
        self.ids = np.array([i for _, i in pairs], np.int64)
        ranks = dict(pairs)
        self.bytes_to_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {(ranks[w[:k]] << 32) | ranks[w[k:]]: i for w, i in pairs for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
        size = int(self.ids.max()) + 1
        entries = [b""] * size
        for w, i in pairs:
            entries[i] = w
        self.lengths = np.fromiter(map(len, entries), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.hash = PerfectHash(self.words)
        self.kept: dict[str, bytes] = {}

    def whole(self, words: list[bytes]) -> list[int]:
        """The id of each word that is an entry, else -1."""
        found, ids, entries = self.hash.find(words).tolist(), self.ids.tolist(), self.words
        return [ids[k] if k >= 0 and entries[k] == w else -1 for k, w in zip(found, words, strict=True)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by merging, lowest rank first, leftmost of equals."""
        ids, n = self.bytes_to_id, len(word)
        get, mask = self.pairs.get, (1 << _PLACE) - 1
        parts = [ids[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := get((parts[i] << 32) | parts[i + 1])) is not None:
                heap.append((r << _PLACE) | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, r = top & mask, top >> _PLACE
            left = parts[i]
            if left < 0 or (j := after[i]) >= n or get((left << 32) | parts[j]) != r:
                continue
            parts[i], parts[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := get((r << 32) | parts[k])) is not None:
                    push(heap, (q << _PLACE) | i)
            if (p := before[i]) >= 0 and (q := get((parts[p] << 32) | r)) is not None:
                push(heap, (q << _PLACE) | p)
        return [p for p in parts if p >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        odd, plain, full = _patterns()
        split = [(plain if not t.encode("utf-8", "surrogatepass").translate(None, _SIMPLE) or odd.isdisjoint(t) else full)(t) for t in texts]
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        fresh = [w for w in set().union(*split) if w not in kept]
        raw = [w.encode("utf-8", "replace") for w in fresh]
        pack = struct.Struct("<i").pack
        for w, b, i in zip(fresh, raw, self.whole(raw), strict=True):
            kept[w] = pack(i) if i >= 0 else array("i", self.merge(b)).tobytes()
        look = kept.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another; unknown ids give none."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        return self.data[at + np.arange(len(at))]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")


#: Bytes of ASCII but four controls, and of the letters from U+00C0 to U+00FF, which both
#: patterns class alike. Bytes from 0x80 to 0xBF only follow another one.
_SIMPLE = bytes(b for b in range(256) if (b < 0x80 and b not in (0x1C, 0x1D, 0x1E, 0x1F)) or b == 0xC3 or 0x80 <= b < 0xC0)


@lru_cache(1)
def _patterns():
    import regex

    odd = frozenset(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and _differs(chr(c)))
    return odd, re.compile(_PLAIN).findall, regex.compile(PATTERN).findall


def _differs(c: str) -> bool:
    """Whether ``re`` and ``regex`` could see another class in this character."""
    if c.isascii():
        return c in "\x1c\x1d\x1e\x1f"
    kind = unicodedata.category(c)
    letter, number, space = kind[0] == "L", kind[0] == "N", c in "\x85\xa0     　" or " " <= c <= " "
    word, digit = c.isalnum() or c == "_", kind == "Nd"
    return (word and not digit) != letter or digit != number or c.isspace() != space or kind == "Cn"


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """A struct of the token ids and whether they decode to the text; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        given = texts.to_pylist()
        packed, exact = [], []
        for s in range(0, len(given), SLICE):
            part = given[s : s + SLICE]
            ids = c.encode([t or "" for t in part])
            packed += ids
            for t, p in zip(part, ids, strict=True):
                exact.append(None if t is None else c.decode_all(np.frombuffer(p, "<i4")).tobytes() == t.encode("utf-8", "replace"))
        offsets = np.zeros(len(given) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4, out=offsets[1:])
        flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        none = pa.array([t is None for t in given], pa.bool_())
        tokens = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=none) if given else pa.array([], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([tokens, pa.array(exact, pa.bool_())], ["ids", "exact"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<ids:array<int>,exact:boolean>")(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids; ids that the vocabulary lacks give nothing; null for null."""

    def run(lists: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if i is None else c.decode([-1 if k is None else k for k in i]) for i in lists.to_pylist()], pa.string())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip`` for each input row.

    A null text gives null ids and round trip and 0 tokens, an empty one no ids; repeated
    rows and null ids stay; further columns are left out. ``round_trip`` tells whether
    decoding the ids gave the text again. No shuffle.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text_col).cast("string"), path).alias("__e"))
    return t.select("doc_id", F.col("__e.ids").alias("token_ids"), F.greatest(F.size("__e.ids"), F.lit(0)).alias("n_tokens"), F.col("__e.exact").alias("round_trip"))
