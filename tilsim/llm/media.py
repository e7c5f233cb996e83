"""Media columns: payloads in tar shards, addressed by content.

Each payload is named by its SHA-256 and stored once; rows carry digest, shard, offset and
length. The metadata columns are filled by range reads of each payload's first bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilsim.llm.common import fresh_path, materialize

#: Bytes of payload that a shard is planned for.
SHARD_BYTES = 64 << 20
#: Bytes that the first range read of a header fetches.
HEAD_BYTES = 4096

_META = "kind string, width int, height int, channels int, sample_rate int, lang string, charset string, title string"
_META_FIELDS = [f.split()[0] for f in _META.split(", ")]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _packed(payload: bytes) -> tuple[str, bytes]:
    """Payloads that zlib shortens by a tenth are stored so; compressed media stay raw.
    Unlike formats that decode block by block, a cut zlib stream decodes up to the cut."""
    small = zlib.compress(payload, 6)
    return ("zlib", small) if len(small) < 0.9 * len(payload) else ("raw", payload)


def _unpacked(codec: str, body: bytes) -> bytes:
    return body if codec == "raw" else zlib.decompress(body)


class Payload:
    """A payload whose bytes are fetched as they are asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes], length: int, codec: str = "raw", size: int | None = None):
        """``fetch(at, n)`` reads n of the ``length`` stored bytes; ``size`` is that of the payload."""
        self.fetch, self.length, self.codec = fetch, length, codec
        self.size = length if size is None else size
        self.have, self.fetched, self.inflate = b"", 0, zlib.decompressobj()

    def first(self, n: int) -> bytes:
        """The first n bytes, or all."""
        while len(self.have) < min(n, self.size) and self.fetched < self.length:
            step = min(self.length, max(HEAD_BYTES, 2 * self.fetched if self.codec != "raw" else n)) - self.fetched
            body = self.fetch(self.fetched, step)
            self.fetched += len(body)
            self.have += body if self.codec == "raw" else self.inflate.decompress(body)
            if not body:
                break
        return self.have[:n]

    def read(self, at: int, n: int) -> bytes:
        """n bytes from ``at`` on: from what is there, by a range read of their own, or,
        where they are compressed, after all before them."""
        if at + n <= len(self.have) or self.codec != "raw":
            return self.first(at + n)[at:]
        return self.fetch(at, min(n, self.length - at)) if at < self.length else b""


def _jpeg(p: Payload) -> dict[str, object]:
    at = 2
    while len(head := p.read(at, 10)) == 10 and head[0] == 0xFF:
        if 0xC0 <= head[1] <= 0xCF and head[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[5:9])
            return {"width": w, "height": h, "channels": head[9]}
        at += 1 if head[1] == 0xFF else 2 + struct.unpack(">H", head[2:4])[0]
    return {}


def _webp(head: bytes) -> dict[str, object]:
    kind, body = head[12:16], head[20:]
    if kind == b"VP8X" and len(body) >= 10:
        w, h = (int.from_bytes(body[k : k + 3], "little") + 1 for k in (4, 7))
        return {"width": w, "height": h, "channels": 4 if body[0] & 16 else 3}
    if kind == b"VP8L" and len(body) >= 5:
        bits = int.from_bytes(body[1:5], "little")
        return {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "channels": 4 if bits >> 28 & 1 else 3}
    if kind == b"VP8 " and len(body) >= 10:
        w, h = struct.unpack("<HH", body[6:10])
        return {"width": w & 0x3FFF, "height": h & 0x3FFF, "channels": 3}
    return {}


_MP3_RATES = ((11025, 12000, 8000), (0, 0, 0), (22050, 24000, 16000), (44100, 48000, 32000))


def _mp3(p: Payload) -> dict[str, object] | None:
    """Of the frame after the tags."""
    at, head = 0, p.read(0, 10)
    while head[:3] == b"ID3" and len(head) == 10:
        at += 10 + sum((head[6 + k] & 127) << 7 * (3 - k) for k in range(4)) + (10 if head[5] & 16 else 0)
        head = p.read(at, 10)
    if len(head) >= 4 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] >> 3 & 3 != 1 and head[1] >> 1 & 3 and head[2] >> 4 not in (0, 15) and head[2] >> 2 & 3 < 3:
        return {"sample_rate": _MP3_RATES[head[1] >> 3 & 3][head[2] >> 2 & 3], "channels": 1 if head[3] >> 6 == 3 else 2}
    return {} if at else None


def _boxes(p: Payload, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, beginning and end of the contents of each box between two places."""
    while at + 8 <= end and len(head := p.read(at, 16)) >= 8:
        size, own = struct.unpack(">I", head[:4])[0], 8
        if size == 1 and len(head) == 16:
            size, own = struct.unpack(">Q", head[8:16])[0], 16
        size = size or end - at
        if size < own:
            return
        yield head[4:8], at + own, min(at + size, end)
        at += size


def _mp4(p: Payload) -> dict[str, object]:
    """The largest picture and the sound of the tracks, by the sizes of the boxes."""
    out: dict[str, object] = {}
    inside = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
    todo = [(0, p.size)]
    while todo:
        for name, at, end in _boxes(p, *todo.pop()):
            if name in inside:
                todo.append((at, end))
            elif name == b"tkhd":
                body = p.read(at, min(end - at, 104))
                if len(body) >= 84:
                    w, h = (x >> 16 for x in struct.unpack(">II", body[-8:] if len(body) < 96 else body[88:96]))
                    if w * h > int(out.get("width", 0)) * int(out.get("height", 0)):
                        out |= {"width": w, "height": h}
            elif name == b"stsd":
                body = p.read(at, 44)
                if body[12:16] in (b"mp4a", b"Opus", b"fLaC", b"alac", b"ac-3") and len(body) == 44:
                    out |= {"channels": struct.unpack(">H", body[32:34])[0], "sample_rate": struct.unpack(">I", body[40:44])[0] >> 16}
    return out


_PAGE = (("lang", r"<html[^>]*\blang=[\"']?([\w\-]+)"), ("charset", r"<meta[^>]*\bcharset=[\"']?([\w\-]+)"), ("title", r"(?s)<title[^>]*>(.*?)</title>"))


def _html(p: Payload) -> dict[str, object]:
    """From as much of the page as its head takes."""
    n = HEAD_BYTES
    while True:
        head = p.first(n)
        text = head.decode("utf-8", "replace")
        found = {name: m[1].strip() for name, pattern in _PAGE if (m := re.search(pattern, text, re.I))}
        if len(found) == len(_PAGE) or len(head) < n or re.search("</head|<body", text, re.I):
            return found
        n *= 4


def sniff(payload: Payload | bytes) -> dict[str, object]:
    """Kind, size, sound and page metadata of a payload, from the bytes its header takes:
    the first HEAD_BYTES, and further ranges where the header says that it goes on."""
    p = payload if isinstance(payload, Payload) else Payload(lambda at, n: payload[at : at + n], len(payload))
    out: dict[str, object] = dict.fromkeys(_META_FIELDS)
    head = p.first(HEAD_BYTES)
    low = head[:512].lstrip().lower()
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 26:
        w, h = struct.unpack(">II", head[16:24])
        out |= {"kind": "png", "width": w, "height": h, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[25])}
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        w, h = struct.unpack("<HH", head[6:10])
        out |= {"kind": "gif", "width": w, "height": h}
    elif head[:2] == b"BM" and len(head) >= 30:
        w, h = struct.unpack("<ii", head[18:26])
        out |= {"kind": "bmp", "width": w, "height": abs(h), "channels": struct.unpack("<H", head[28:30])[0] // 8}
    elif head[:3] == b"\xff\xd8\xff":
        out |= {"kind": "jpeg"} | _jpeg(p)
    elif head[:4] == b"RIFF" and head[8:12] == b"WAVE" and len(head) >= 28:
        channels, rate = struct.unpack("<HI", head[22:28])
        out |= {"kind": "wav", "channels": channels, "sample_rate": rate}
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        out |= {"kind": "webp"} | _webp(head)
    elif head[4:8] == b"ftyp":
        out |= {"kind": "mp4"} | _mp4(p)
    elif head[:4] == b"fLaC":
        rate = int.from_bytes(head[18:22], "big") if len(head) >= 22 else None
        out |= {"kind": "flac"} | ({"sample_rate": rate >> 12, "channels": (rate >> 9 & 7) + 1} if rate is not None else {})
    elif head[:5] == b"%PDF-":
        out["kind"] = "pdf"
    elif low.startswith((b"<!doctype html", b"<html")) or b"<head" in low:
        out |= {"kind": "html"} | _html(p)
    elif (sound := _mp3(p)) is not None:
        out |= {"kind": "mp3"} | sound
    elif head:
        out["kind"] = "text" if b"\0" not in head else "binary"
    return out


class _Shards:
    """Tar shards of one task attempt. A shard appears under its name once it is whole;
    names hold a part of their own for each attempt, so a lost or repeated attempt leaves
    files that no row speaks of, and rows always speak of whole ones."""

    def __init__(self, root: str, task: int, most: int):
        self.stem, self.most, self.k = f"{root}/shard-{task:06d}-{uuid.uuid4().hex[:12]}", most, 0
        self.out = None

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        """Where the member's bytes will stand: shard, offset, length."""
        if self.out is None:
            self.uri = f"{self.stem}-{self.k:04d}.tar"
            self.system, self.path = _filesystem(self.uri)
            self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.out, self.at = self.system.open_output_stream(self.path + ".part"), 0
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head + body + b"\0" * (-len(body) % 512))
        where = (self.uri, self.at + len(head), len(body))
        self.at += len(head) + len(body) + -len(body) % 512
        return where

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.system.move(self.path + ".part", self.path)
            self.out, self.k = None, self.k + 1


def _left_to_others(path: str, task: int) -> frozenset[str]:
    """The digests that a task has but another one writes."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = _filesystem(f"{path}/p={task}")
    if system.get_file_info(base).type == fs.FileType.NotFound:
        return frozenset()
    files = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")]
    return frozenset(d for f in files for d in pq.ParquetFile(system.open_input_file(f)).read(["digest"])["digest"].to_pylist())


def _stored(given: DataFrame, root: str, skip: str, shard_bytes: int) -> DataFrame:
    kind = given.schema["__id"].dataType.simpleString()
    names = ["__id", "digest", "shard", "offset", "length", "codec", "raw_length"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        others, shards, seen, waiting = _left_to_others(skip, task), _Shards(root, task, shard_bytes), set(), []
        kinds = None

        def flush() -> pa.RecordBatch:
            shards.close()
            columns = list(zip(*waiting, strict=True)) if waiting else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            waiting.clear()
            return out

        for b in batches:
            kinds = [b.schema.field("__id").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            for key, payload in zip(b["__id"].to_pylist(), b["__payload"], strict=True):
                p = payload.as_py()
                if p is None:
                    waiting.append((key, *[None] * 6))
                    continue
                digest = hashlib.sha256(p).hexdigest()
                if digest in seen or digest in others:
                    waiting.append((key, digest, None, None, None, None, len(p)))
                    continue
                seen.add(digest)
                codec, body = _packed(p)
                waiting.append((key, digest, *shards.add(digest, body), codec, len(p)))
                if shards.full:
                    yield flush()
        if kinds is not None:
            yield flush()

    return given.mapInArrow(write, f"__id {kind}, digest string, shard string, offset bigint, length bigint, codec string, raw_length bigint")


def store(payloads: DataFrame, id_col: str, payload_col: str, root: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``<id_col>, digest, shard, offset, length, codec, raw_length`` for each input row.

    Equal payloads share one entry. A null payload has nulls; an empty one is an entry of
    length 0. Repeated rows and null ids stay; further columns are left out. ``root`` is a
    folder that all executors share, by default in the session's shared one.

    Payloads aren't shuffled. A first pass finds digests that several tasks have and leaves
    each to the first of them; every task reads its own list of those left to others from
    the shared folder and writes the rest. Only digests and places are joined afterwards.
    Should the second pass see other partitions than the first, a payload that no task
    wrote is written then, from a join on its digest.
    """
    spark = payloads.sparkSession
    root = root or fresh_path(spark, "media")
    given = payloads.select(F.col(id_col).alias("__id"), F.col(payload_col).cast("binary").alias("__payload"))
    have = given.filter("__payload IS NOT NULL").select(F.spark_partition_id().alias("p"), F.sha2("__payload", 256).alias("digest")).distinct()
    many = have.groupBy("digest").agg(F.min("p").alias("owner"), F.collect_set("p").alias("all")).filter(F.size("all") > 1)
    skip = fresh_path(spark, "media-skip")
    many.select("digest", F.explode(F.array_remove("all", F.col("owner"))).alias("p")).write.partitionBy("p").parquet(skip)
    rows = materialize(_stored(given, root, skip, shard_bytes), "media-rows")
    placed = rows.filter("shard IS NOT NULL").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "codec")).alias("at"))
    lost = rows.filter("digest IS NOT NULL").select("digest").distinct().join(placed, "digest", "left_anti")
    if not lost.isEmpty():
        lost = materialize(lost, "media-lost")
        again = given.withColumn("digest", F.sha2("__payload", 256)).join(lost, "digest", "left_semi").drop("digest")
        more = materialize(_stored(again, root, f"{skip}-none", shard_bytes), "media-rows")
        placed = placed.unionByName(more.filter("shard IS NOT NULL").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "codec")).alias("at")))
    out = rows.select("__id", "digest", "raw_length").join(placed, "digest", "left")
    return out.select(F.col("__id").alias(id_col), "digest", "at.shard", "at.offset", "at.length", "at.codec", "raw_length")


def _opened(b: pa.RecordBatch) -> Iterator[Payload | None]:
    """The payload of each row; a shard stays open while its rows follow each other."""
    at, handle = None, None
    for shard, offset, length, codec, size in zip(*(b[c].to_pylist() for c in ("shard", "offset", "length", "codec", "raw_length")), strict=True):
        if shard is None:
            yield None
            continue
        if shard != at:
            if handle:
                handle.close()
            system, path = _filesystem(shard)
            handle, at = system.open_input_file(path), shard
        yield Payload(lambda k, n, handle=handle, offset=offset: handle.read_at(n, offset + k), length, codec, size)
    if handle:
        handle.close()


def with_metadata(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`store` with the metadata columns, each filled by range reads of
    what its header takes; nulls for a null payload and for what a header doesn't say."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*rows.schema.fields, *_parse_datatype_string(_META).fields])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            metas = [dict.fromkeys(_META_FIELDS) if p is None else sniff(p) for p in _opened(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[f] for m in metas], k) for f, k in zip(_META_FIELDS, kinds, strict=True))], [*b.schema.names, *_META_FIELDS])

    return rows.mapInArrow(fill, schema)


def fetch(rows: DataFrame, id_col: str) -> DataFrame:
    """``<id_col>, payload, intact``: the payloads, read back by range, and whether they
    still have the digest that names them."""
    kind = rows.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                got = [None if p is None else _unpacked(p.codec, p.fetch(0, p.length)) for p in _opened(part)]
                good = [None if x is None else hashlib.sha256(x).hexdigest() == d for x, d in zip(got, part["digest"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part[id_col], pa.array(got, pa.binary()), pa.array(good, pa.bool_())], [id_col, "payload", "intact"])

    return rows.mapInArrow(read, f"`{id_col}` {kind}, payload binary, intact boolean")


def media_columns(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", root: str | None = None) -> DataFrame:
    """``<id_col>, digest, shard, offset, length, codec, raw_length`` and the metadata columns
    for each input row.

    Equal payloads share one entry. A null payload has nulls throughout; an empty one is an
    entry of length 0 without a kind; an endless one is read by its header only. Repeated
    rows and null ids stay, further columns are left out, an empty table gives an empty one.
    """
    return with_metadata(store(pages, id_col, payload_col, root))


#: The columns that SQL can make: the digest names the payload, so they fix what is stored.
DIGESTS_SQL = """SELECT page_id, sha256(html) AS digest, strlen(html)::BIGINT AS raw_length,
    CASE WHEN regexp_matches(html, '^\\s*<(!doctype html|html)', 'i') THEN 'html' WHEN html = '' THEN NULL ELSE 'text' END AS kind,
    trim(nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), ''), E' \\t\\n\\r') AS title FROM pages"""
