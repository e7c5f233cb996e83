"""Substring de-duplication with prefix-partitioned suffix trees.

A repeated substring of at least LEAST bytes is found from the suffixes that begin at its
anchors. Anchors are winnowed: the windows of WINDOW bytes whose hash is least among
WINDOW neighbours, so equal substrings of 2 x WINDOW - 1 bytes have an anchor in common.

1. Each text sends the hash of each anchor's window to a bucket. A window that occurs once
   can't begin a repeat; one whose occurrences all follow the same earlier anchor begins
   no maximal one. The others are the prefixes that split the suffixes into groups.
2. The bytes of each group are counted. A group that fits in a task keeps its prefix of
   WINDOW bytes. Where the suffixes of a prefix have more bytes, the prefix is lengthened
   to all that they share and the next character, again and again until each part fits:
   the prefixes that part the suffixes differ in length.
3. A text cuts its suffixes where the windows that others share end and sends such a run
   to the groups of its prefixes once, with the places of its suffixes in it.
4. A group is sorted into a suffix tree in memory (order, common prefixes). Its internal
   nodes from the deepest up, with what their leaves share to the left, give each leaf its
   maximal repeats. The nodes above the groups, whose prefixes had to be lengthened, give
   theirs by a sort of what stands before their leaves.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilsim.llm.common import materialize, pieces, text_bytes

#: Shortest repeat that is reported, in bytes of UTF-8.
LEAST = 200
#: Bytes of an anchor's window, and neighbours among which its hash is the least.
WINDOW = 100
#: Bytes of anchors, and of text, that one task holds at once.
_BUCKET = 12 << 20
_BLOCK = 4 << 20
_CHUNK = 1 << 21
#: Bytes of the runs of one group; a prefix with more is lengthened.
GROUP = 16 << 20
#: Suffixes of one group that together have at most so many bytes are copied.
_COPIED = 4 << 20
#: Bytes that one step of lengthening looks at, and steps after which a group goes to one
#: task as it is (runs of one repeated word, whose parts differ in length alone).
_AHEAD = 4096
_STEPS = 12
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slide(h: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each run of n neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        h = pick(h[:-step], h[step:])
        have += step
    return h


def anchors(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text of at least 2 x window - 1 bytes."""
    n = len(data)
    if n < 2 * window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, np.uint64)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - window, _B_INVERSE, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[:-1])])
        h = _mix((sums[window:] - sums[:-window]) * inverse)
    least = _slide(h, window, np.minimum)
    # a place is an anchor if its hash is the least of some run of neighbours that holds it
    reach = _slide(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    at = np.flatnonzero(reach == h)
    return at, h[at]


def _by_bucket(to: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    by = np.argsort(to, kind="stable")
    to = to[by]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    ends = np.append(cuts[1:], len(to)) if len(cuts) else cuts
    out = {"bucket": pa.array(to[cuts].astype(np.int64), pa.int64())}
    for name, values in columns.items():
        sorted_ = values[by]
        out[name] = pa.array([sorted_[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return out


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), kind)


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class Suffixes:
    """Suffixes of several texts as places, not as copies: their ranks and common prefixes.

    Ranks of the first 2^j bytes at every place, by doubling; a suffix ends where its text
    does. All levels are held: 4 bytes for each place and level."""

    def __init__(self, texts: list[bytes], row: np.ndarray, off: np.ndarray):
        size = np.array([len(x) for x in texts], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        self.pos, self.ends = edge[row] + off, edge[row + 1]
        n = int(edge[-1])
        end = np.repeat(edge[1:], size)
        rank = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32) + 1
        self.levels, step, most = [rank], 1, int(size.max(initial=0))
        while step < most:
            then = np.zeros(n, np.int64)
            then[:-step] = rank[step:]
            then[np.arange(step, n + step) >= end] = 0
            found, rank = np.unique(rank * np.int64(n + 258) + then, return_inverse=True)
            rank = rank.astype(np.int32) + 1
            self.levels.append(rank)
            step *= 2
            if len(found) == n:
                break
        self.keys = rank[self.pos].tolist()

    def __len__(self) -> int:
        return len(self.pos)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y, end, other = self.pos[a], self.pos[b], self.ends[a], self.ends[b]
        for j in range(len(self.levels) - 1, -1, -1):
            on = np.flatnonzero((x < end) & (y < other))
            on = on[self.levels[j][x[on]] == self.levels[j][y[on]]]
            step = np.minimum(1 << j, end[on] - x[on])
            x[on] += step
            y[on] += step
        return x - self.pos[a]


class Copies:
    """The same for few bytes in all: the suffixes themselves are the keys."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([_common_prefix(self.keys[i], self.keys[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def _reach(near: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an order, the interval around it whose neighbours share ``least``;
    ``near[k]`` is what the elements k - 1 and k share, and 0 at both ends."""
    mins = [near]
    while 2 << (len(mins) - 1) <= len(near):
        half = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-half], mins[-1][half:]))
    low, high = at.copy(), at + 1
    for j in range(len(mins) - 1, -1, -1):
        step = 1 << j
        on = np.flatnonzero(high + step <= len(near))
        on = on[mins[j][high[on]] >= least[on]]
        high[on] += step
        on = np.flatnonzero(low - step + 1 >= 0)
        on = on[mins[j][low[on] - step + 1] >= least[on]]
        low[on] -= step
    return low, high


class Tree:
    """The suffix tree of one group: leaves in the order of their suffixes and in that of
    what stands before them (``left``, back to front), with what neighbours share."""

    def __init__(self, right: Suffixes | Copies, left: list[bytes]):
        n = self.n = len(right)
        self.left = left
        self.order = sorted(range(n), key=lambda i: (right.keys[i], left[i]))
        by = np.array(self.order, np.int64)
        self.deep = np.concatenate([[0], right.common(by[:-1], by[1:]), [0]]).astype(np.int64)
        self.back_order = np.array(sorted(range(n), key=left.__getitem__), np.int64)
        self.place, self.back_place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[by] = self.back_place[self.back_order] = np.arange(n)
        self.by, self._near = by, None

    @property
    def near(self) -> np.ndarray:
        if self._near is None:
            b = self.back_order.tolist()
            self._near = np.array([0, *(_common_prefix(self.left[i], self.left[j]) for i, j in zip(b, b[1:], strict=False)), 0], np.int64)
        return self._near

    def pairs(self, least: int, most_left: int) -> list[tuple[int, int, int]]:
        """(leaf, bytes to the left, bytes to the right): what each leaf shares with others,
        without what lies within more of the same leaf; at least ``least`` bytes in all.

        From the deepest node up, the leaves of a node stand in the order of what precedes
        them; of two that are joined the smaller is sorted into the larger, and a leaf shares
        most to the left with a neighbour there. With ``most_left`` bytes to the left the
        pair meets at an earlier anchor too, and is left to it.
        """
        best, out, left = [-1] * self.n, [], self.left

        def met(i: int, j: int, depth: int) -> None:
            if best[i] >= most_left and best[j] >= most_left:
                return
            c = _common_prefix(left[i], left[j])
            for k in (i, j):
                if c > best[k]:
                    best[k] = c
                    if c < most_left and c + depth >= least:
                        out.append((k, c, depth))

        deep = self.deep.tolist()
        back = self.back_order.tolist()
        parts: dict[int, list[int]] = {i: [p] for i, p in enumerate(self.back_place[self.by].tolist())}
        head = list(range(self.n))

        def find(x: int) -> int:
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        for k in np.argsort(-self.deep[1 : self.n], kind="stable").tolist():
            depth = deep[k + 1]
            if depth <= 0:
                break
            a, b = find(k), find(k + 1)
            if len(parts[a]) < len(parts[b]):
                a, b = b, a
            head[b] = a
            into = parts[a]
            for y in parts.pop(b):
                at = bisect_left(into, y)
                if at:
                    met(back[into[at - 1]], back[y], depth)
                if at < len(into):
                    met(back[into[at]], back[y], depth)
                into.insert(at, y)
        # of equal depth the later pair may share more to the left
        last: dict[tuple[int, int], int] = {(k, depth): c for k, c, depth in out}
        return [(k, c, depth) for k, c, depth in out if last[k, depth] == c]

    def occurrences(self, leaf: np.ndarray, back: np.ndarray, depth: np.ndarray, weight: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of what stands from ``back`` bytes before the leaf to ``depth`` after: the sum of
        the weights of the leaves that have it, and the least of their ranks."""
        low, high = _reach(self.deep, self.place[leaf], depth)
        first, last = _reach(self.near, self.back_place[leaf], back)
        found, inverse = np.unique(np.stack([low, high, first, last]), axis=1, return_inverse=True)
        n, least = np.empty(found.shape[1], np.int64), np.empty(found.shape[1], np.int64)
        for k, (a, b, c, d) in enumerate(found.T.tolist()):
            if b - a <= d - c:
                some = self.by[a:b]
                there = self.back_place[some]
                some = some[(there >= c) & (there < d)]
            else:
                some = self.back_order[c:d]
                there = self.place[some]
                some = some[(there >= a) & (there < b)]
            n[k], least[k] = weight[some].sum(), rank[some].min()
        inverse = inverse.ravel()
        return n[inverse], least[inverse]


def tree(right: Suffixes | Copies, left: list[bytes], least: int, most_left: int = 1 << 60) -> tuple[np.ndarray, list[int]]:
    """The maximal repeats of each leaf of a group, as columns of :meth:`Tree.pairs`, and
    the order of the leaves."""
    t = Tree(right, left)
    return np.array(t.pairs(least, most_left), np.int64).reshape(-1, 3).T, t.order


def _inner(byte: int) -> bool:
    return byte & 0xC0 == 0x80


def _digest(span: bytes) -> int:
    """As Spark's xxhash64 has it."""
    h = xxhash.xxh64_intdigest(span, 42)
    return h - (1 << 64) if h >> 63 else h


def _chars(raw: Column) -> Column:
    """Characters that begin in ``raw``, which may begin or end within one."""
    return F.octet_length(F.regexp_replace(F.hex(raw), "([89AB].)|(..)", "$2")) / 2


def _cut_left(raw: Column, off: Column, c: Column) -> Column:
    """``c`` less the bytes of a character cut at the left end."""
    first = F.hex(F.substring(raw, off - c + 1, F.least(c, F.lit(3))))
    return (c - F.octet_length(F.regexp_extract(first, "^((?:[89AB].)*)", 1)) / 2).cast("int")


_SPAN = "tid bigint, start int, length int, n bigint, first {kind}, repeat_id bigint"


def _spans(runs: list[tuple], row: list[int], off: list[int], least: int, window: int, out: list[tuple]) -> None:
    """Adds the repeats of one group to ``out``: (tid, start, length, n, first, repeat_id).
    ``runs`` are (raw, tid, rows of this text, least id, characters before it)."""
    pairs = list(zip(row, off, strict=True))
    left = [runs[i][0][max(0, s - window) : s][::-1] for i, s in pairs]
    own = np.array(row, np.int64)
    size = sum(len(runs[i][0]) - s for i, s in pairs)
    if size <= _COPIED:
        right = Copies([runs[i][0][s:] for i, s in pairs])
    else:
        some, index = np.unique(own, return_inverse=True)
        right = Suffixes([runs[i][0] for i in some.tolist()], index, np.array(off, np.int64))
    t = Tree(right, left)
    found = []
    for k, c, depth in t.pairs(least, window):
        i, s = pairs[k]
        raw = runs[i][0]
        p, q = s - c, s + depth
        while p < q and _inner(raw[p]):  # characters cut at either end go
            p += 1
        while p < q < len(raw) and _inner(raw[q]):
            q -= 1
        if q - p >= least:
            found.append((k, s - p, q - s, p, q))
    if not found:
        return
    some = np.array(found, np.int64)
    ids = sorted({runs[i][3] for i in row if runs[i][3] is not None})
    rank = {d: k for k, d in enumerate(ids)}
    ranks = np.array([rank.get(runs[i][3], len(ids)) for i in row], np.int64)
    weight = np.array([runs[i][2] for i in row], np.int64)
    n, first = t.occurrences(some[:, 0], some[:, 1], some[:, 2], weight, ranks)
    for (k, _, _, p, q), count, least_id in zip(found, n.tolist(), first.tolist(), strict=True):
        raw, tid, _, _, before = runs[pairs[k][0]]
        span = raw[p:q]
        out.append((tid, before + len(raw[:p].decode("utf-8", "ignore")), len(span.decode("utf-8", "ignore")), count, ids[least_id] if least_id < len(ids) else None, _digest(span)))


def _span_table(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), kind, pa.int64()]
    names = [c.split()[0] for c in _SPAN.split(", ")]
    return pa.table({c: pa.array([r[k] for r in rows], x) for k, (c, x) in enumerate(zip(names, kinds, strict=True))})


def _lengthened(large: DataFrame, least: int, window: int, group: int, kind: str) -> DataFrame:
    """The repeats of groups too large for a task. ``large`` has a row for each suffix:
    ``cls, raw, off, tid, rows, least_id, before``, where ``raw`` is its run and ``off`` its
    place there. All suffixes of a class share ``depth`` bytes.

    Each round finds all that a class shares, reports what its leaves share to the left at
    that depth, and parts it by the next character; parts that fit become trees.
    """
    given = large.schema["least_id"].dataType
    rows = large.withColumn("depth", F.lit(window)).withColumn("left", F.reverse(F.hex(F.expr(f"substring(raw, greatest(off - {window}, 0) + 1, least(off, {window}))"))))
    found: list[DataFrame] = []

    def trees(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        runs = list(zip(t["raw"].to_pylist(), t["tid"].to_pylist(), t["rows"].to_pylist(), t["least_id"].to_pylist(), t["before"].to_pylist(), strict=True))
        if t.num_rows > 1:
            _spans(runs, list(range(t.num_rows)), t["off"].to_pylist(), least, window, out)
        return _span_table(out, t["least_id"].type)

    def shared(low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(low.to_pylist(), high.to_pylist(), strict=True):
            n = _common_prefix(a, b)
            more = max(len(a), len(b))
            if n == more == _AHEAD:  # more may follow: without the last character, which may be cut
                n -= 1
            while 0 < n < more and _inner((a if n < len(a) else b)[n]):
                n -= 1  # whole characters
            out.append(n)
        return pa.array(out, pa.int32())

    shared.__annotations__ = {"low": pa.Array, "high": pa.Array, "return": pa.Array}
    shared_bytes = F.arrow_udf(shared, "int")

    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([_common_prefix(x, y) // 2 if x is not None and y is not None else 0 for x, y in pairs], pa.int32())

    alike.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    shared_left = F.arrow_udf(alike, "int")
    ahead = F.expr(f"substring(raw, off + depth + 1, {_AHEAD})")
    for step in range(_STEPS + 1):
        size = rows.groupBy("cls").agg(F.sum(F.expr("octet_length(raw) - off")).alias("bytes"), F.count(F.lit(1)).alias("many"), F.min(ahead).alias("low"), F.max(ahead).alias("high"))
        size = size.filter("many > 1").select("cls", ((F.col("bytes") <= group) | F.lit(step == _STEPS)).alias("fits"), shared_bytes("low", "high").alias("more"), (F.col("low") == F.col("high")).alias("same"), (F.octet_length("high") < _AHEAD).alias("ends"))
        size = materialize(size, "substring-prefixes")
        fit = rows.join(size.filter("fits"), "cls", "left_semi")
        found.append(fit.groupBy("cls").applyInArrow(trees, _SPAN.format(kind=kind)))
        if not size.filter("NOT fits").head(1):
            break
        rest = rows.join(size.filter("NOT fits"), "cls").withColumn("depth", F.col("depth") + F.col("more"))
        rest = materialize(rest, "substring-large")
        # a node: its leaves in the order of what stands before them; where all agree on
        # _AHEAD bytes and go on, the node lies deeper
        w = Window.partitionBy("cls").orderBy("left")
        leaves = rest.filter("NOT same OR ends").withColumn("c", F.greatest(shared_left("left", F.lag("left").over(w)), shared_left("left", F.lead("left").over(w))))
        leaves = leaves.withColumn("c", _cut_left(F.col("raw"), F.col("off"), F.col("c")))
        leaves = materialize(leaves.filter(F.col("c") < window).filter(F.col("c") + F.col("depth") >= least), "substring-nodes")
        asked = leaves.select("cls", "c", F.expr("substring(left, 1, 2 * c)").alias("l")).distinct()
        lengths = asked.select("cls", "c").distinct()
        counts = rest.select("cls", "left", "rows", "least_id").join(lengths, "cls").filter("octet_length(left) >= 2 * c").groupBy("cls", "c", F.expr("substring(left, 1, 2 * c)").alias("l")).agg(F.sum("rows").alias("n"), F.min("least_id").alias("first"))
        nodes = leaves.withColumn("l", F.expr("substring(left, 1, 2 * c)")).join(counts, ["cls", "c", "l"])
        span = F.expr("substring(raw, off - c + 1, c + depth)")
        found.append(nodes.select("tid", (F.col("before") + _chars(F.expr("substring(raw, 1, off - c)"))).cast("int").alias("start"), _chars(span).cast("int").alias("length"), F.col("n").cast("bigint").alias("n"), F.col("first").cast(given).alias("first"), F.xxhash64(span).alias("repeat_id")))
        byte = F.hex(F.expr("substring(raw, off + depth + 1, 1)"))
        head = F.when(byte < "80", 1).when(byte < "E0", 2).when(byte < "F0", 3).otherwise(4)
        goes_on = rest.filter(F.expr("octet_length(raw) > off + depth")).withColumn("__k", F.when(F.col("same"), F.lit(0)).otherwise(head))
        parted = goes_on.withColumn("cls", F.xxhash64("cls", F.expr("substring(raw, off + depth + 1, __k)"))).withColumn("depth", F.col("depth") + F.col("__k"))
        rows = materialize(parted.select("cls", "raw", "off", "tid", "rows", "least_id", "before", "depth", "left"), "substring-parts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, start, length, n_occurrences, first_doc_id, repeat_id``: the maximal places
    of each document whose substring stands at another place of the corpus too.

    A place has at least ``least`` bytes of whole characters, and with one character more at
    either end its substring would occur nowhere else. ``start`` counts characters from 0,
    ``length`` too. ``n_occurrences`` counts all places of the substring in all rows,
    overlapping ones and those within longer repeats too; ``first_doc_id`` is the least id
    that has it, null if only rows without an id have; equal substrings have one
    ``repeat_id``. A text that other rows repeat whole has one place, all of it, in each
    such row. Null, empty and short texts give no rows; repeated rows count as copies; rows
    with a null id count like others; further columns are left out. An empty table gives an
    empty one. ``group`` sets the bytes from which a prefix is lengthened and changes no
    result. Needs 2 x window - 1 <= least.
    """
    if 2 * window - 1 > least:
        raise ValueError("the windows are too long for this length")
    total = text_bytes(docs, text_col)
    buckets = pieces(total // 2, _BUCKET)
    blocks = pieces(total, _BLOCK)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") >= least)
    given = given.withColumn("tid", F.xxhash64("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for b in batches:
            raw, tids = b["text"].cast(pa.binary()).to_pylist(), b["tid"].to_pylist()
            at = 0
            while at < len(raw):
                to, size = at, 0
                while to < len(raw) and (to == at or size < 4 * _CHUNK):
                    size += len(raw[to])
                    to += 1
                hs, ts, ps, bs = [], [], [], []
                for text, tid in zip(raw[at:to], tids[at:to], strict=True):
                    p, h = anchors(np.frombuffer(text, np.uint8), window)
                    with np.errstate(over="ignore"):  # what stands before: the anchor before and its distance, or this text's beginning
                        first = _mix(np.array([tid], np.int64).view(np.uint64))
                        prev = _mix(np.concatenate([first, h[:-1]]) + np.diff(p, prepend=0).astype(np.uint64))
                    hs.append(h)
                    ts.append(np.full(len(h), tid, np.int64))
                    ps.append(p.astype(np.int32))
                    bs.append((prev & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                at = to
                h = np.concatenate(hs)
                columns = {"h": h, "tid": np.concatenate(ts), "pos": np.concatenate(ps), "prev": np.concatenate(bs)}
                yield pa.RecordBatch.from_pydict(_by_bucket((h % np.uint64(buckets)).astype(np.int64), columns))

    def shared(t: pa.Table) -> pa.Table:
        h, tid, pos, prev = _joined(t, "h", np.uint64), _joined(t, "tid", np.int64), _joined(t, "pos", np.int32), _joined(t, "prev", np.uint32)
        by = np.argsort(h, kind="stable")
        hs = h[by]
        same = np.concatenate([[False], hs[1:] == hs[:-1]])
        many = same | np.concatenate([same[1:], [False]])  # windows that occur once go first
        by = by[many]
        by = by[np.lexsort((pos[by], tid[by], h[by]))]
        h, tid, pos, prev = h[by], tid[by], pos[by], prev[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1])]) if len(h) else np.zeros(0, bool)
        h, tid, pos, prev = h[new], tid[new], pos[new], prev[new]  # rows that repeat a whole text count once here
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(h)))
        differ = np.maximum.reduceat(prev, starts) != np.minimum.reduceat(prev, starts) if len(starts) else np.zeros(0, bool)
        keep = np.repeat(size > 1, size)
        diverse = np.repeat(differ, size)[keep]
        h, tid, pos = h[keep], tid[keep], pos[keep]
        return pa.table(_by_bucket(np.mod(tid, blocks), {"h": h, "tid": tid, "pos": pos, "begins": diverse}))

    found = given.select("tid", "text").mapInArrow(find, "bucket bigint, h binary, tid binary, pos binary, prev binary")
    marked = materialize(found.groupBy("bucket").applyInArrow(shared, "bucket bigint, h binary, tid binary, pos binary, begins binary"), "substring-anchors")

    def runs_of(marks: pa.Table) -> tuple[np.ndarray, ...]:
        """The anchors of a block by text and place: text, place, hash, whether it begins a
        suffix, the end of its run of shared windows and the number of this run."""
        tids, pos, h, begins = _joined(marks, "tid", np.int64), _joined(marks, "pos", np.int32).astype(np.int64), _joined(marks, "h", np.uint64), _joined(marks, "begins", np.bool_)
        by = np.lexsort((pos, tids))
        tids, pos, h, begins = tids[by], pos[by], h[by], begins[by]
        last = np.ones(len(tids), bool)
        last[:-1] = (tids[1:] != tids[:-1]) | (np.diff(pos) > window)
        at = np.flatnonzero(last)
        run = np.searchsorted(at, np.arange(len(tids)))
        return tids, pos, h, begins, pos[at][run] + 2 * window if len(at) else pos, run

    def measure(marks: pa.Table) -> pa.Table:
        _, pos, h, begins, end, run = runs_of(marks)
        h, pos, end, run = h[begins], pos[begins], end[begins], run[begins]
        by = np.lexsort((pos, run, h))
        first = np.ones(len(by), bool)  # a run goes to a group once
        first[1:] = (h[by][1:] != h[by][:-1]) | (run[by][1:] != run[by][:-1])
        by = by[first]
        prefix, inverse = np.unique(h[by], return_inverse=True)
        return pa.table({"h": pa.array(prefix.view(np.int64)), "bytes": pa.array(np.bincount(inverse, (end - pos)[by] + window, len(prefix)).astype(np.int64))})

    # prefixes to be lengthened: at most (bytes of the runs / group) of them
    sizes = marked.groupBy("bucket").applyInArrow(measure, "h bigint, bytes bigint").groupBy("h").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > group)
    too_large = np.sort(sizes.select("h").toArrow()["h"].to_numpy().view(np.uint64))

    by_block = given.withColumn("bucket", F.pmod("tid", F.lit(blocks)))
    groups = pieces(total, _BLOCK)
    columns = {"bucket": pa.int64(), "hs": pa.binary(), "offs": pa.binary(), "raw": pa.binary(), "tid": pa.int64(), "rows": pa.int64(), "doc_id": None, "least_id": None, "before": pa.int32()}
    suffix = f"bucket bigint, hs binary, offs binary, raw binary, tid bigint, rows bigint, doc_id {kind}, least_id {kind}, before int"

    def cut(t: pa.Table, marks: pa.Table) -> pa.Table:
        """Bucket -1 has the rows of repeated texts, -2 the suffixes of too large groups."""
        cols: dict[str, list] = {c: [] for c in columns}

        def add(*row):
            for c, v in zip(cols.values(), row, strict=True):
                c.append(v)

        texts: dict[int, tuple[bytes, list]] = {}
        for doc, tid, raw in zip(t["doc_id"].to_pylist(), t["tid"].to_pylist(), t["text"].cast(pa.binary()), strict=True):
            if tid in texts:
                texts[tid][1].append(doc)
            else:
                texts[tid] = (raw.as_py(), [doc])
        tids, pos, h, begins, end, run = runs_of(marks)
        cuts = np.flatnonzero(np.concatenate([[True], tids[1:] != tids[:-1]])) if len(tids) else np.zeros(0, np.int64)
        where = {} if not len(tids) else dict(zip(tids[cuts].tolist(), zip(cuts.tolist(), np.append(cuts[1:], len(tids)).tolist(), strict=True), strict=True))
        for tid, (raw, owners) in texts.items():
            least_id = min((d for d in owners if d is not None), default=None)
            if len(owners) > 1:
                for d in owners:
                    add(-1, None, None, None, tid, len(owners), d, least_id, len(raw.decode("utf-8")))
            a, b = where.get(tid, (0, 0))
            k = a + np.flatnonzero(begins[a:b])
            if not len(k):
                continue
            data = np.frombuffer(raw, np.uint8)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            common = (tid, len(owners), owners[0] if len(owners) == 1 else None, least_id)
            apart = np.isin(h[k], too_large)
            for x in k[apart].tolist():
                s = max(0, int(pos[x]) - window)
                add(-2, h[x : x + 1].tobytes(), np.array([pos[x] - s], ">i4").tobytes(), raw[s : int(end[x])], *common, int(chars[s]))
            k = k[~apart]
            to = (h[k] % np.uint64(groups)).astype(np.int64)
            by = np.lexsort((k, run[k], to))  # a run goes to each group once, with the places of its suffixes there
            k, to = k[by], to[by]
            if not len(k):
                continue
            firsts = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (run[k][1:] != run[k][:-1])]))
            for x, y in zip(firsts.tolist(), np.append(firsts[1:], len(k)).tolist(), strict=True):
                own = k[x:y]
                s = max(0, int(pos[own[0]]) - window)
                add(int(to[x]), h[own].tobytes(), (pos[own] - s).astype(np.int32).tobytes(), raw[s : int(end[own[0]])], *common, int(chars[s]))
        return pa.table({c: pa.array(v, columns[c] or t["doc_id"].type) for c, v in cols.items()})

    cut_up = materialize(by_block.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(cut, suffix), "substring-suffixes")
    span = _SPAN.format(kind=kind)

    def trees(t: pa.Table) -> pa.Table:
        h, off = _joined(t, "hs", np.uint64), _joined(t, "offs", np.int32)
        row = np.repeat(np.arange(t.num_rows), [len(x) // 4 for x in t["offs"].to_pylist()])
        by = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]])) if len(by) else np.zeros(0, np.int64)
        runs = list(zip(t["raw"].to_pylist(), t["tid"].to_pylist(), t["rows"].to_pylist(), t["least_id"].to_pylist(), t["before"].to_pylist(), strict=True))
        out: list[tuple] = []
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(by)).tolist(), strict=True):
            if b - a > 1:
                _spans(runs, row[by[a:b]].tolist(), off[by[a:b]].tolist(), least, window, out)
        # of one text, places within another one go
        out.sort(key=lambda r: (r[0], r[1], -r[2], -r[3]))
        kept, tid, last = [], None, -1
        for r in out:
            if r[0] != tid:
                tid, last = r[0], -1
            if r[1] + r[2] > last:
                last = r[1] + r[2]
                kept.append(r)
        return _span_table(kept, t["least_id"].type)

    parts = cut_up.filter("bucket >= 0").groupBy("bucket").applyInArrow(trees, span)
    if len(too_large):
        alone = cut_up.filter("bucket = -2").select(F.xxhash64("hs").alias("cls"), "raw", F.expr("cast(conv(hex(offs), 16, 10) as int)").alias("off"), "tid", "rows", "least_id", "before")
        parts = parts.unionByName(_lengthened(alone, least, window, group, kind))
    rows = cut_up.filter("bucket = -1").select("tid", "doc_id", "least_id", F.col("before").alias("length"), "rows")
    whole = rows.groupBy("tid").agg(F.lit(0).alias("start"), F.max("length").alias("length"), F.max("rows").alias("n"), F.min("least_id").alias("first"), F.max("tid").alias("repeat_id"))
    each = parts.unionByName(whole).groupBy("tid", "start", "length", "repeat_id").agg(F.max("n").alias("n_occurrences"), F.min("first").alias("first_doc_id"))
    end = F.col("start") + F.col("length")
    covered = F.max(end).over(Window.partitionBy("tid").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("__end", covered).filter(F.col("__end").isNull() | (end > F.col("__end"))).drop("__end")
    single = cut_up.filter("bucket != -1 AND rows = 1").groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    owners = rows.select("tid", "doc_id").unionByName(single)
    return each.join(owners, "tid").select("doc_id", "start", "length", "n_occurrences", "first_doc_id", "repeat_id")
