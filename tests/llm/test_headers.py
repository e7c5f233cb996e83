"""Headers that go on beyond the first range read, compressed or not."""

import struct
import zlib

import pytest

from tilsim.llm import media


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


JPEG = b"\xff\xd8\xff\xe1" + struct.pack(">H", 60_002) + b"e" * 60_000 + b"\xff\xe2" + struct.pack(">H", 9_002) + b"i" * 9_000 + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 200, 300) + b"\x03" + b"z" * 900
TKHD = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 1280 << 16, 720 << 16))
SOUND = box(b"stsd", struct.pack(">II", 0, 1) + struct.pack(">I", 36) + b"mp4a" + b"\0" * 16 + struct.pack(">HHII", 2, 16, 0, 48_000 << 16))
MP4 = box(b"ftyp", b"isom0000") + box(b"mdat", b"m" * 70_000) + box(b"moov", box(b"mvhd", b"\0" * 100) + box(b"trak", TKHD) + box(b"trak", box(b"tkhd", b"\0" * 84) + box(b"mdia", box(b"minf", box(b"stbl", SOUND)))))
FRAME = b"\xff\xfb\x90\x00" + b"f" * 400
ID3 = b"ID3\x04\x00\x00" + bytes([0, 1, 0, 0]) + b"p" * (1 << 14)
FLAC = b"fLaC\0\0\0\x22" + b"\0" * 10 + (44_100 << 12 | 1 << 9).to_bytes(4, "big") + b"\0" * 20
HTML = b"<!DOCTYPE html><html lang=tr><head>" + b"<script>var a = 1;</script>" * 4000 + b"<meta charset=utf-8><title>Son\nbirim</title></head><body><title>no</title>"
CASES = {
    "jpeg": (JPEG, {"width": 300, "height": 200, "channels": 3}),
    "mp4": (MP4, {"width": 1280, "height": 720, "channels": 2, "sample_rate": 48_000}),
    "mp3": (ID3 + FRAME, {"channels": 2, "sample_rate": 44_100}),
    "flac": (FLAC, {"channels": 2, "sample_rate": 44_100}),
    "webp": (b"RIFF0000WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"), {"width": 640, "height": 480, "channels": 4}),
    "html": (HTML, {"lang": "tr", "charset": "utf-8", "title": "Son\nbirim"}),
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("codec", ["raw", "zlib"])
def test_headers(kind, codec):
    raw, want = CASES[kind]
    stored = raw if codec == "raw" else zlib.compress(raw)
    read = []

    def fetch(at, n):
        read.append(n)
        return stored[at : at + n]

    got = media.sniff(media.Payload(fetch, len(stored), codec, len(raw)))
    assert {k: v for k, v in got.items() if v is not None} == {"kind": kind} | want
    if kind == "jpeg" and codec == "raw":
        assert sum(read) < 5000  # ranges, not the whole


@pytest.mark.parametrize("cut", range(0, 60, 7))
@pytest.mark.parametrize("kind", CASES)
def test_cut_headers_are_no_error(kind, cut):
    assert media.sniff(CASES[kind][0][:cut]).keys() == media.sniff(b"").keys()
    media.sniff(CASES[kind][0][: len(CASES[kind][0]) - cut])
