"""Near-duplicates by SimHash and the general pigeonhole principle.

Every document gets a 256-bit sketch. Bits that go together are grouped into partitions;
a dynamic program gives each partition its own threshold, so that together they cover the
search at the least estimated number of rows and candidates. A sketch is sent to all
values that differ from its own in at most half the threshold; two sketches within the
threshold meet at a value between them. Sets that meet are verified on whole sketches and
joined into components. Sets of any size are handled in full: within a set a breadth-first
search compares each member only with those not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilsim.llm.common import free_names, materialize, pieces

BITS = 256
PARTITIONS = 8
#: Sketches that differ in at most so many bits are near-duplicates.
DISTANCE = 34
#: Up to this distance the search is exact; between it and DISTANCE a pair is missed only
#: if every partition exceeds its own threshold (recall: see the README).
EXACT = 21
#: Numbers of at most so many rows are broadcast: about 64 MB.
MOST_SENT = 4_000_000
_WIDTH = BITS // PARTITIONS
_CHUNK = 1 << 21
#: Weight of the words of a text against its pairs where none recurs.
_WORDS = 6.0
#: Bytes of probes that one task sorts at once.
_BUCKET = 24 << 20
#: Cost of a probe row against that of a candidate pair.
_ROW_COST, _PAIR_COST = 1.0, 2.0

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in the texts between offsets: hash, length, and words before each text."""
    is_word = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(data) else is_word
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate([is_word[1:], [False]]) if len(data) else is_word
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    power = np.cumprod(np.full(len(data) + 1, _K[0], np.uint64))
    inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_K[0]), -1, 1 << 64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) * _K[1] + _K[2]) * power[:-1])])
    n = ends - starts
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + n.astype(np.uint64)), n, np.searchsorted(starts, offsets)


def _signs(h: np.ndarray) -> np.ndarray:
    wide = np.empty((len(h), 4), np.uint64)
    for i, k in enumerate(_K):
        wide[:, i] = _mix(h ^ k)
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)


def _total(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The weighted sum of the signs of the hashes, scaled to a mean square of 1, and how
    far the hashes are distinct: 1 if all are, less the more the weightiest recur."""
    total = np.zeros(BITS, np.float32)
    for s in range(0, len(h), 8192):
        w = weight[s : s + 8192]
        total += 2 * (w @ _signs(h[s : s + 8192])) - w.sum()
    square = max(float((total.astype(np.float64) ** 2).mean()), 1e-9)
    return total / square**0.5, min(1.0, float((weight.astype(np.float64) ** 2).sum()) / square)


def sketches(texts: list[str | None]) -> list[bytes]:
    """32 bytes per text. Words weigh by their length (longer ones are rarer), adjacent
    pairs by their shorter word. Next to the pairs the words count the less, the more they
    recur, so that long texts don't meet by the vocabulary of their language. A text
    without words, null as well as empty, gets a digest of its characters instead."""
    import hashlib

    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    out: list[bytes] = []
    at = 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= _CHUNK):
                size += len(raw[to])
                to += 1
            part = raw[at:to]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
            h, n, first = _words(np.frombuffer(b"".join(part), np.uint8), offsets)
            weight = np.clip(n - 2.0, 0.25, 8.0).astype(np.float32)
            for k, text in enumerate(part):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    out.append(hashlib.blake2b(text, digest_size=32).digest())
                    continue
                total, distinct = _total(h[a:b], weight[a:b])
                if b - a > 1:
                    pairs, _ = _total(_mix(h[a : b - 1] * _K[3] + h[a + 1 : b]), np.minimum(weight[a : b - 1], weight[a + 1 : b]))
                    total = _WORDS * distinct * total + pairs
                out.append(np.packbits(total > 0).tobytes())
            at = to
    return out


def sketch(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sketches(texts.to_pylist()), pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _summed(nodes: DataFrame, per_batch, size: int) -> np.ndarray:
    """The sum over all sketches of an array of ``size`` numbers per batch, in two steps of
    about the square root of the number of tasks each, so the driver gets few arrays."""
    groups = max(1, int(nodes.rdd.getNumPartitions() ** 0.5))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += per_batch(_matrix(b["sk"]))
        yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for v in t["v"].to_pylist():
            total += np.frombuffer(v, np.int64)
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(size, np.int64)
    for r in nodes.select("sk").mapInArrow(partial, "g int, v binary").groupBy("g").applyInArrow(merge, "v binary").collect():
        total += np.frombuffer(r["v"], np.int64)
    return total


def group_bits(together: np.ndarray, n: int) -> np.ndarray:
    """An order of the bits, partition after partition: each begins with the free bit that
    correlates most with the others and takes those that correlate most with it so far."""
    ones = np.diag(together).astype(float)
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, order = list(range(BITS)), []
    while free:
        first = max(free, key=lambda b: (r[b, free].sum(), -b))
        own = [first]
        free.remove(first)
        while len(own) < _WIDTH:
            nxt = max(free, key=lambda b: (r[b, own].sum(), -b))
            own.append(nxt)
            free.remove(nxt)
        order += own
    return np.array(order)


_POP = np.array([bin(i).count("1") for i in range(256)])
_AWAY = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


def estimate_pairs(counts: np.ndarray, n: int) -> np.ndarray:
    """Expected pairs per partition within 0, 1 and 2 bits, from the counts of each byte."""
    out = np.zeros((PARTITIONS, 3))
    for i in range(PARTITIONS):
        near = np.array([1.0, 0, 0])
        for byte in counts[i * _WIDTH // 8 : (i + 1) * _WIDTH // 8]:
            q = byte / max(n, 1)
            d = np.array([(q[:, None] * q[None, :] * (_AWAY == k)).sum() for k in range(3)])
            near = np.array([near[0] * d[0], near[0] * d[1] + near[1] * d[0], near[0] * d[2] + near[1] * d[1] + near[2] * d[0]])
        out[i] = np.cumsum(near) * n * (n - 1) / 2
    return out


def allocate(pairs: np.ndarray, n: int, exact: int = EXACT) -> list[int]:
    """Thresholds from -1 (partition unused) to 2, such that the sum of threshold + 1 is
    at least ``exact`` + 1, at the least cost. Dynamic program over partitions and sum."""
    probes = [0, 1, _WIDTH + 1, _WIDTH + 1]
    need = exact + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(pairs)):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t in (-1, 0, 1, 2):
                c = cost + _ROW_COST * probes[t + 1] * n + (_PAIR_COST * pairs[i][t] if t >= 0 else 0.0)
                key = min(need, have + t + 1)
                if key not in nxt or c < nxt[key][0]:
                    nxt[key] = (c, [*chosen, t])
        best = nxt
    if need not in best:
        raise ValueError("the partitions can't cover this distance")
    return best[need][1]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order: how many each partition has, then their 32-bit values."""
    return np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=PARTITIONS).astype(np.uint32).tobytes() + keys.astype(np.uint32).tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    n = np.frombuffer(blob, np.uint32, PARTITIONS)
    return np.repeat(np.arange(PARTITIONS, dtype=np.uint64) << np.uint64(32), n) | np.frombuffer(blob, np.uint32, offset=4 * PARTITIONS)


def _pack_ids(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint32).tobytes() + (ids >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack_ids(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _node(m: np.ndarray) -> np.ndarray:
    """48 bits that stand for a sketch while candidates are sought. Should two sketches
    share them, both are candidates; what joins documents is compared on whole sketches."""
    w = np.ascontiguousarray(m).view(np.uint64)
    h = _mix(w[:, 0] ^ _K[0])
    for i in range(1, 4):
        h = _mix(h ^ (w[:, i] * _K[i]))
    return h >> np.uint64(16)


def probes(m: np.ndarray, order: np.ndarray, thresholds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all values that the sketches are sent to, and the row of each."""
    parts = np.ascontiguousarray(np.packbits(np.unpackbits(m, axis=1)[:, order], axis=1)).view(">u4").astype(np.uint64)
    keys, rows = [], []
    flips = np.concatenate([[0], 1 << np.arange(_WIDTH)]).astype(np.uint64)
    for i, t in enumerate(thresholds):
        if t >= 0:
            near = flips if t > 0 else flips[:1]
            keys.append((parts[:, i : i + 1] ^ near[None, :] | np.uint64(i << 32)).ravel())
            rows.append(np.repeat(np.arange(len(m)), len(near)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def spanning(m: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the components of rows within ``distance``: breadth first, each row
    is compared with the rows not reached yet."""
    words = np.ascontiguousarray(m).view(np.uint64)
    left, edges = np.arange(len(m)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(words[left] ^ words[a]).sum(axis=1) <= distance
            if near.any():
                found = left[near]
                edges += [(a, int(b)) for b in found]
                queue += found.tolist()
                left = left[~near]
    return edges


def _edges(nodes: DataFrame, n: int, order: np.ndarray, thresholds: list[int], distance: int) -> DataFrame:
    each = sum((0, 1, _WIDTH + 1, _WIDTH + 1)[t + 1] for t in thresholds)
    buckets = pieces(n * each * 16, _BUCKET)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                with np.errstate(over="ignore"):
                    m = _matrix(b["sk"].slice(s, 4096))
                    keys, rows = probes(m, order, thresholds)
                    ids = _node(m)[rows]
                    to = (_mix(keys) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((keys, to))
                keys, ids, to = keys[by], ids[by], to[by]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                ends = np.append(cuts[1:], len(to))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(to[cuts], pa.int64()),
                    "keys": pa.array([_pack_keys(keys[x:y]) for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                    "ids": pa.array([_pack_ids(ids[x:y]) for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                })

    def meet(t: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_keys(b) for b in t["keys"].to_pylist()])
        ids = np.concatenate([_unpack_ids(b) for b in t["ids"].to_pylist()])
        by = np.lexsort((ids, keys))
        keys, ids = keys[by], ids[by]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, ids = keys[first], ids[first]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(keys)))
        with np.errstate(over="ignore"):
            mixed = np.add.reduceat(_mix(ids), starts) + size.astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
        _, pick = np.unique(mixed, return_index=True)
        pick = pick[size[pick] > 1]
        n_of = size[pick]
        at = np.repeat(starts[pick] - (np.cumsum(n_of) - n_of), n_of) + np.arange(int(n_of.sum()))
        return pa.table({"met": pa.array(np.repeat(mixed[pick], n_of).view(np.int64)), "node": pa.array(ids[at].view(np.int64))})

    def verify(t: pa.Table) -> pa.Table:
        met, m = t["met"].to_numpy(), _matrix(t["sk"].combine_chunks())
        by = np.argsort(met, kind="stable")
        met, m = met[by], m[by]
        starts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        ends = np.append(starts[1:], len(met))
        a, b = [], []
        two = starts[ends - starts == 2]
        w = np.ascontiguousarray(m).view(np.uint64)
        near = two[np.bitwise_count(w[two] ^ w[two + 1]).sum(axis=1) <= distance]
        a += near.tolist()
        b += (near + 1).tolist()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > 2:
                for x, y in spanning(m[s:e], distance):
                    a.append(s + x)
                    b.append(s + y)
        pairs = {(min(x, y), max(x, y)) for x, y in ((m[i].tobytes(), m[j].tobytes()) for i, j in zip(a, b, strict=True)) if x != y}
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    met = nodes.select("sk").mapInArrow(emit, "bucket bigint, keys binary, ids binary").groupBy("bucket").applyInArrow(meet, "met bigint, node bigint").distinct()
    met = materialize(met, "simhash-met")
    known = nodes.select("sk", "node")
    many = pieces(met.count() * 64, _BUCKET)
    return met.join(known, "node").withColumn("part", F.pmod(F.xxhash64("met"), F.lit(many))).groupBy("part").applyInArrow(verify, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b``: the least node of its component.

    Large-star and small-star steps until nothing changes; each round is written to the
    shared folder, so the plan doesn't grow and lost executors cost a round at most.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("m"), "a")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        links = materialize(small.filter("a != b").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _grouped(rows: DataFrame, distance: int, exact: int) -> DataFrame:
    """``rows`` (__row, doc_id, sk) with ``root``: the least sketch of the group."""
    def node(column: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            return pa.array(_node(_matrix(column)).view(np.int64))

    node.__annotations__ = {"column": pa.Array, "return": pa.Array}
    nodes = materialize(rows.select("sk").distinct().withColumn("node", F.arrow_udf(node, "bigint")("sk")), "simhash-nodes")
    n = nodes.count()
    if n < 2:
        return rows.withColumn("root", F.col("sk"))

    def together(m: np.ndarray) -> np.ndarray:
        x = np.unpackbits(m, axis=1).astype(np.float32)
        return np.rint(x.T @ x).astype(np.int64).ravel()

    order = group_bits(_summed(nodes, together, BITS * BITS).reshape(BITS, BITS), n)

    def histogram(m: np.ndarray) -> np.ndarray:
        p = np.packbits(np.unpackbits(m, axis=1)[:, order], axis=1)
        return np.bincount((p + np.arange(BITS // 8)[None, :] * 256).ravel(), minlength=BITS // 8 * 256)

    counts = _summed(nodes, histogram, BITS // 8 * 256).reshape(BITS // 8, 256)
    thresholds = allocate(estimate_pairs(counts, n), n, exact)
    roots = components(_edges(nodes, n, order, thresholds, distance))
    return rows.join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))


def _first(grouped: DataFrame) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    return grouped.groupBy("root").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("group_size"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, exact: int = EXACT) -> DataFrame:
    """``doc_id, group_id, group_size, keep`` for each input row.

    Groups are the connected components of documents whose sketches differ in at most
    ``distance`` bits; ``group_id`` is the least id of the group and that row is kept, of
    repeated rows one, a null id only if the group has no other. Texts without words, null
    ones included, group only with the same characters. Further columns are left out.
    Sketches are shuffled, texts never.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("doc_id"), sketch(F.col(text_col).cast("string")).alias("sk")), "simhash-rows")
    grouped = materialize(_grouped(rows, distance, exact), "simhash-groups")
    out = grouped.join(_first(grouped), "root")
    return out.select("doc_id", F.col("__first.id").alias("group_id"), "group_size", (F.col("__row") == F.col("__first.row")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, exact: int = EXACT) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`; columns as they are.

    Up to MOST_SENT rows that go are broadcast as numbers, so that no text is shuffled;
    beyond it Spark joins by sort.
    """
    row, sk = free_names(docs.columns, "__row", "__sk")
    own = [F.col(f"`{c}`") for c in docs.columns]
    stored = materialize(docs.select(*own, F.monotonically_increasing_id().alias(row), sketch(F.col(text_col).cast("string")).alias(sk)), "simhash-docs")
    grouped = materialize(_grouped(stored.select(F.col(row).alias("__row"), F.col(id_col).alias("doc_id"), F.col(sk).alias("sk")), distance, exact), "simhash-groups")
    gone = grouped.join(_first(grouped).filter("group_size > 1"), "root").filter(F.col("__row") != F.col("__first.row")).select(F.col("__row").alias(row))
    gone = materialize(gone, "simhash-gone")
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    return stored.join(gone, row, "left_anti").select(*own)
