"""Language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions, each with its own context tree over the
preceding bytes, up to DEPTH of them. Counts come from all documents. A node weighs its
Krichevsky-Trofimov estimate against the product of its children, P_w = (P_e + prod P_w) / 2,
down to the full depth, where P_w = P_e; the weights that this gives mix the estimates of
all depths into one probability for each decision. A document's score is its code length
under this mixture, per byte. With folds, the counts of the document's own fold are taken
out of every node first: what is left is a code that others have paid for.

Passes by blocks or by context, none by way of the driver but for the two topmost levels:
blocks of documents count their grams; the counts of FAN blocks are merged, and those of
FAN merged ones again until FAN are left; the trees below each pair of nearest bytes are
weighted apart; every gram's cost goes back the same way to the blocks that have it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilsim.llm.common import materialize, pieces, text_bytes

#: Preceding bytes of the longest context.
DEPTH = 4
#: The same for scores that leave a fold out, and the number of folds.
HELD_OUT_DEPTH = 5
FOLDS = 4
#: Counts of so many blocks are merged at once.
FAN = 64
#: Bytes of text that a block is planned for.
BLOCK_BYTES = 6 << 20
_DENSE = 1 << 25


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of the texts: keys in ascending order (nearest context byte in
    the highest place, then the farther ones, last the byte itself), how often each
    occurs, the gram at each position and the positions before each text. Before a text
    stand zero bytes."""
    pad = b"\0" * depth
    buf = np.frombuffer(pad.join([b"", *texts]) if texts else b"", np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    at = np.arange(total, dtype=np.int64) + np.repeat(depth * np.arange(1, len(texts) + 1), n)
    used = np.flatnonzero(np.bincount(buf, minlength=256))
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))
    sym, a = place[buf], len(used)
    ids, size, keys = np.zeros(total, np.int64), 1, np.zeros(1, np.uint64)
    for back in [*range(1, depth + 1), 0]:
        key = ids * a + sym[at - back]
        if size * a <= max(_DENSE, 4 * total):
            there = np.zeros(size * a, bool)
            there[key] = True
            found = np.flatnonzero(there)
            new = np.cumsum(there) - 1
            ids = new[key]
        else:
            found, ids = np.unique(key, return_inverse=True)
        keys = (keys[found // a] << np.uint64(8)) | used[found % a].astype(np.uint64)
        size = len(found)
    return keys, np.bincount(ids, minlength=size), ids, offsets


_LOG_HALF = log(0.5)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for whole numbers."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument beyond 8; good to 1e-12."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - 2 * lgamma(0.5) - _log_gamma(zeros + ones + 1.0)


def _log_mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) + _LOG_HALF


class Level:
    """The nodes of one depth: (context, decision) with counts, ln P_e and ln P_w."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones = node, zeros, ones
        self.log_e = log_kt(zeros, ones)
        self.log_w = self.log_e if below is None else _log_mean(self.log_e, below)
        # the share of the node's own estimate in its mixture
        self.own = np.ones(len(node)) if below is None else np.exp(np.minimum(0.0, self.log_e + _LOG_HALF - self.log_w))

    def up(self) -> Level:
        """One byte of context less: node = context << 8 | decision."""
        parent = (self.node >> np.uint64(16) << np.uint64(8)) | (self.node & np.uint64(255))
        node, inverse = np.unique(parent, return_inverse=True)
        total = lambda v: np.bincount(inverse, v, len(node))
        return Level(node, total(self.zeros), total(self.ones), total(self.log_w))

    def mix(self, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The probability of each decision: the node's own estimate and that of the ``deeper``
        nodes by the node's share. A node without counts has nothing to say: NaN, and what
        lies above it decides."""
        if not len(self.node):
            return deeper
        k = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        n = np.where(self.node[k] == node, self.zeros[k] + self.ones[k], 0.0)
        p = (np.where(bit == 1, self.ones[k], self.zeros[k]) + 0.5) / (n + 1)
        mixed = np.where(np.isnan(deeper), p, self.own[k] * p + (1 - self.own[k]) * deeper)
        return np.where(n > 0, mixed, deeper)


def _decisions(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its eight decisions, numbered as in a heap, and how they fall."""
    s = symbol.astype(np.uint64)[:, None] | np.uint64(256)
    down = np.arange(8, 0, -1, dtype=np.uint64)[None, :]
    return s >> down, (s >> (down - np.uint64(1))) & np.uint64(1)


def bottom(keys: np.ndarray, counts: np.ndarray) -> Level:
    decision, bit = _decisions(keys & np.uint64(255))
    full = ((keys >> np.uint64(8) << np.uint64(8))[:, None] | decision).ravel()
    node, inverse = np.unique(full, return_inverse=True)
    c, b = np.repeat(counts, 8), bit.ravel()
    return Level(node, np.bincount(inverse, c * (b == 0), len(node)), np.bincount(inverse, c * (b == 1), len(node)), None)


def costs(keys: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """Bits to code each gram's byte, given the levels from the root to the full depth."""
    decision, bit = _decisions(keys & np.uint64(255))
    decision, bit = decision.ravel(), bit.ravel()
    context = np.repeat(keys >> np.uint64(8), 8)
    p = np.full(len(bit), np.nan)
    for d in range(depth, -1, -1):
        p = levels[d].mix((context >> np.uint64(8 * (depth - d)) << np.uint64(8)) | decision, bit, p)
    p = np.where(np.isnan(p), 0.5, p)
    return -np.log2(p).reshape(-1, 8).sum(axis=1)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).tobytes() + counts.astype(np.uint32).tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint64, n)), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    parts = [_unpack(b) for b in blobs]
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys))
    return keys, counts, np.split(inverse, np.cumsum([len(k) for k, _ in parts])[:-1])


def _trees(t: pa.Table, depth: int, top: int, folds: int) -> tuple[np.ndarray, list[np.ndarray], Iterator[list[Level]]]:
    """The grams of one context, the place of each blob's grams among them, and for each
    fold in turn the levels from ``top`` to the full depth without the fold's counts (with
    one fold: with all counts)."""
    keys, counts, places = _merged(t["grams"].to_pylist())

    def levels() -> Iterator[list[Level]]:
        for f in range(folds):
            left = counts.astype(np.float64)
            for k, place in enumerate(places):
                if folds > 1 and t["fold"][k].as_py() == f:
                    left[place] -= _unpack(t["grams"][k].as_py())[1]
            some = left > 0  # grams that the others lack have nothing to say
            out = [bottom(keys[some], left[some])]
            for _ in range(depth - top):
                out.append(out[-1].up())
            yield out[::-1]

    return keys, places, levels()


def _state(level: Level, fold: int) -> pa.Table:
    some = level.zeros + level.ones > 0
    return pa.table({"fold": pa.array(np.full(int(some.sum()), fold, np.int32)), "node": pa.array(level.node[some].view(np.int64)), "zeros": pa.array(level.zeros[some], pa.float64()), "ones": pa.array(level.ones[some], pa.float64()), "log_w": pa.array(level.log_w[some], pa.float64())})


_STATE = "fold int, node bigint, zeros double, ones double, log_w double"
_BLOBS = "context int, block int, fold int, grams binary"


def _restored(t: pa.Table) -> Level:
    level = Level(t["node"].to_numpy().view(np.uint64), t["zeros"].to_numpy(), t["ones"].to_numpy(), None)
    level.log_w = t["log_w"].to_numpy()
    return level


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None, block_bytes: int = BLOCK_BYTES, folds: int = 1, fan: int = FAN) -> DataFrame:
    """``doc_id, n_bytes, bits, bits_per_byte`` for each input row.

    With one fold the model holds the counts of all documents, the scored one among them.
    With more, rows are dealt to folds by a hash of id and text, and each is coded by the
    counts of all rows of the other folds; a context that those lack leaves the decision to
    the next shorter one, and where there are no others each bit costs one. ``depth`` is
    DEPTH or, with folds, HELD_OUT_DEPTH unless given.

    A null text counts as empty; both have 0 bits and a null score. Repeated rows stay,
    count as often as they occur and, having equal ids, share a fold; null ids stay; further
    columns are left out; an empty table gives an empty one. Texts are shuffled to blocks by
    a hash of id and text; contexts by their two nearest bytes, in which one task holds the
    distinct grams of a context. What reaches the driver are the nodes of depth 1 and 0: at
    most folds x 257 x 255 rows, whatever the input.
    """
    depth = depth or (DEPTH if folds == 1 else HELD_OUT_DEPTH)
    if not 2 <= depth <= 7:
        raise ValueError("depth is from 2 to 7")
    blocks = folds * pieces(text_bytes(docs, text_col), block_bytes * folds)
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    kind = given.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(8 * (depth - 1))

    def raw(t: pa.Table) -> list[bytes]:
        return t["text"].cast(pa.large_binary()).to_pylist()

    def count(t: pa.Table) -> pa.Table:
        keys, counts, _, _ = grams(raw(t), depth)
        group = (keys >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(cuts[1:], len(keys)) if len(cuts) else cuts
        block = t["block"][0].as_py()
        same = lambda v: pa.array(np.full(len(cuts), v, np.int32))
        return pa.table({"context": pa.array(group[cuts].astype(np.int32)), "block": same(block), "fold": same(block % folds), "grams": pa.array([_pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        """The counts of one context over FAN blocks of one fold."""
        keys, counts, _ = _merged(t["grams"].to_pylist())
        one = t.slice(0, 1)
        return pa.table({"context": one["context"], "block": pa.array([one["block"][0].as_py() // fan], pa.int32()), "fold": one["fold"], "grams": pa.array([_pack(keys, counts)], pa.binary())})

    steps = [materialize(given.groupBy("block").applyInArrow(count, _BLOBS), "ctw-counts")]
    while blocks > fan:
        blocks = -(-blocks // fan)
        up = steps[-1].groupBy("context", "fold", F.floor(F.col("block") / fan).alias("up"))
        steps.append(materialize(up.applyInArrow(merge, _BLOBS), "ctw-merged"))
    top = steps[-1]

    def second(t: pa.Table) -> pa.Table:
        return pa.concat_tables([_state(levels[0], f) for f, levels in enumerate(_trees(t, depth, 2, folds)[2])])

    def first(t: pa.Table) -> pa.Table:
        up = _restored(t).up()
        return _state(up, t["fold"][0].as_py()).append_column("own", pa.array(up.own, pa.float64()))

    # node at depth 2: nearest byte << 16 | next byte << 8 | decision
    nodes = top.groupBy("context").applyInArrow(second, _STATE)
    ones = nodes.groupBy("fold", F.shiftright("node", 16).alias("nearest")).applyInArrow(first, _STATE + ", own double").orderBy("fold", "node").toArrow()
    above = []
    for f in range(folds):
        own = ones.filter(pc.equal(ones["fold"], f))
        level1 = _restored(own)
        level1.own = own["own"].to_numpy()
        above.append([level1.up(), level1])

    def price(t: pa.Table) -> pa.Table:
        keys, places, trees = _trees(t, depth, 2, folds)
        own = t["fold"].to_pylist()
        out: list[bytes | None] = [None] * len(own)
        for f, tree in enumerate(trees):
            for k, place in enumerate(places):
                if own[k] == f or folds == 1:
                    out[k] = costs(keys[place], [*above[f], *tree], depth).astype(np.float32).tobytes()
        return pa.table({"context": t["context"], "block": t["block"], "fold": t["fold"], "bits": pa.array(out, pa.binary())})

    def hand_down(t: pa.Table, prices: pa.Table) -> pa.Table:
        _, _, places = _merged(t["grams"].to_pylist())
        bits = np.frombuffer(prices["bits"][0].as_py(), np.float32)
        return pa.table({"context": t["context"], "block": t["block"], "fold": t["fold"], "bits": pa.array([bits[p].tobytes() for p in places], pa.binary())})

    priced = top.groupBy("context").applyInArrow(price, "context int, block int, fold int, bits binary")
    for below in steps[-2::-1]:
        lower = below.groupBy("context", "fold", F.floor(F.col("block") / fan).cast("int").alias("up"))
        priced = lower.cogroup(priced.groupBy("context", "fold", "block")).applyInArrow(hand_down, "context int, block int, fold int, bits binary")

    def code(t: pa.Table, prices: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array([], pa.int64()), "bits": pa.array([], pa.float64()), "bits_per_byte": pa.array([], pa.float64())})
        _, _, ids, offsets = grams(raw(t), depth)
        by = np.argsort(prices["context"].to_numpy(), kind="stable")
        blobs = prices["bits"].to_pylist()
        each = np.frombuffer(b"".join(blobs[i] for i in by), np.float32).astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(each[ids])]) if len(ids) else np.zeros(1)
        bits, n = total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets)
        per = pa.array(np.round(bits / np.maximum(n, 1), 6), pa.float64(), mask=n == 0)
        return pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array(n), "bits": pa.array(np.round(bits, 3)), "bits_per_byte": per})

    return given.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(code, f"doc_id {kind}, n_bytes bigint, bits double, bits_per_byte double")
