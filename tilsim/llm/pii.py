"""Format-preserving pseudonyms for personal data.

Card numbers (Luhn), phone numbers, social security numbers, IBANs, IPv4 addresses,
calendar dates, e-mail addresses and long hexadecimal secrets are found and validated;
each valid value is permuted within its own format by a keyed Feistel network, which walks
on until its value validates too. The same value gets the same pseudonym in every document,
and the key can undo it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import warnings
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for trials: whoever knows it can undo the pseudonyms. See :func:`session_key`.
KEY = b"tilsim-demonstration-key"
ROUNDS = 8


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.tilsim.pii.key`` of the session; without one the key for trials,
    with a warning."""
    found = spark.conf.get("spark.tilsim.pii.key", None)
    if found:
        return found.encode()
    warnings.warn("spark.tilsim.pii.key isn't set: pseudonyms are made with the public key for trials", stacklevel=2)
    return KEY


def _round(key: bytes, tweak: bytes, i: int, half: int, modulus: int) -> int:
    data = tweak + bytes([i]) + half.to_bytes((half.bit_length() + 8) // 8, "big")
    size = (modulus.bit_length() + 7) // 8 + 8
    out = hashlib.blake2b(data, key=key[:64], digest_size=min(64, size)).digest()
    while len(out) < size:
        out += hashlib.blake2b(data + out[-64:], key=key[:64], digest_size=64).digest()
    return int.from_bytes(out, "big") % modulus


def permute(x: int, n: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over a x b >= n, whose values
    beyond n are sent round again until they fall below it."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def walk(x: int, n: int, key: bytes, tweak: bytes, inverse: bool, valid: Callable[[int], bool]) -> int:
    """A keyed permutation of those of 0..n-1 that are valid, as ``x`` is."""
    while True:
        x = permute(x, n, key, tweak, inverse)
        if valid(x):
            return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits_into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _number(s: str, key: bytes, kind: bytes, inverse: bool, fixed: int = 0) -> str:
    """Permutes the digits of ``s`` but for the first ``fixed``; signs between stay."""
    d = _only_digits(s)
    head, tail = d[:fixed], d[fixed:]
    return _digits_into(s, head + str(permute(int(tail), 10 ** len(tail), key, kind + head.encode(), inverse)).zfill(len(tail)))


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def _cards(run: str) -> list[tuple[int, int]]:
    """The card numbers in a run of groups of digits, from the left: the whole run if it is
    one; else, at borders of groups and from a group of four digits or more, the shortest."""
    if _is_card(_only_digits(run)):
        return [(0, len(run))]
    groups, found, i = [m.span() for m in re.finditer("[0-9]+", run)], [], 0
    while i < len(groups):
        size, end = 0, None
        for k in range(i, len(groups)):
            size += groups[k][1] - groups[k][0]
            if size > 19:
                break
            if groups[i][1] - groups[i][0] >= 4 and _is_card(_only_digits(run[groups[i][0] : groups[k][1]])):
                end = k
                break
        if end is None:
            i += 1
        else:
            found.append((groups[i][0], groups[end][1]))
            i = end + 1
    return found


def _card(m: re.Match, key: bytes, inverse: bool) -> list[tuple[int, int, str]] | None:
    run = m[0]
    found = _cards(run)
    for s, e in reversed(found) if inverse else found:
        d = _only_digits(run[s:e])

        def whole(x: int, s=s, e=e, n=len(d) - 1) -> str:
            payload = str(x).zfill(n)
            return run[:s] + _digits_into(run[s:e], payload + luhn_digit(payload)) + run[e:]

        # a value that would change which groups are read as cards is passed over
        run = whole(walk(int(d[:-1]), 10 ** (len(d) - 1), key, b"card", inverse, lambda x: _cards(whole(x)) == found))  # noqa: B023
    return [(s, e, run[s:e]) for s, e in found]


def _phone(m: re.Match, key: bytes, inverse: bool) -> str | None:
    d, code = _only_digits(m[0]), _only_digits(m["code"] or "")
    if not 9 <= len(d) <= 15 or len(d) - len(code) < 7:
        return None
    return _number(m[0], key, b"phone", inverse, len(code))


def _ssn(m: re.Match, key: bytes, inverse: bool) -> str | None:
    def valid(x: int) -> bool:
        return bool(x // 10**6 and x // 10**4 % 100 and x % 10**4)

    x = int(_only_digits(m[0]))
    return _digits_into(m[0], str(walk(x, 10**9, key, b"ssn", inverse, valid)).zfill(9)) if valid(x) else None


def _public(x: int) -> bool:
    """An address that isn't 0.x, 127.x or one number four times."""
    octets = x.to_bytes(4, "big")
    return octets[0] not in (0, 127) and len({*octets}) > 1


def _ip(m: re.Match, key: bytes, inverse: bool) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    x = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, walk(x, 1 << 32, key, b"ip", inverse, _public).to_bytes(4, "big"))) if _public(x) else None


#: Years from and to: a date stays in its own span of them.
_SPANS = ((1, 1900), (1900, 2100), (2100, 10_000))


def _date(m: re.Match, key: bytes, inverse: bool) -> str | None:
    a, sep, b, c = m["a"], m["sep"], m["b"], m["c"]
    order = "ymd" if len(a) == 4 else "dmy" if sep == "." else "mdy"
    if len(a) != 4 and int(a) > 12:
        order = "dmy"
    y, month, d = (int((a, b, c)[order.index(k)]) for k in "ymd")
    if not _valid(y, month, d):
        return None
    low, high = next(span for span in _SPANS if span[0] <= y < span[1])
    tweak = b"" if low == 1900 else b":%d" % low
    # where day and month could be told apart only by their size, the pseudonym keeps to
    # days on the same side of 12 in the same order, so that it reads as the same format again
    if order == "ymd" or sep == ".":
        first = dt.date(low, 1, 1).toordinal()
        days = dt.date(high - 1, 12, 31).toordinal() - first + 1
        new = dt.date.fromordinal(first + permute(dt.date(y, month, d).toordinal() - first, days, key, b"date" + tweak, inverse))
        y, month, d = new.year, new.month, new.day
    else:
        days, least = (19, 13) if order == "dmy" else (31, 1)

        def parts(x: int) -> tuple[int, int, int]:
            return low + x // (12 * days), x // days % 12 + 1, x % days + least

        x = ((y - low) * 12 + month - 1) * days + d - least
        y, month, d = parts(walk(x, (high - low) * 12 * days, key, b"date-" + order.encode() + tweak, inverse, lambda x: _valid(*parts(x))))
    return sep.join({"y": f"{y:04d}", "m": f"{month:02d}", "d": f"{d:02d}"}[k] for k in order)


def _valid(y: int, m: int, d: int) -> bool:
    try:
        dt.date(y, m, d)
    except ValueError:
        return False
    return True


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _classes(s: str, key: bytes, kind: bytes, inverse: bool, alphabets: tuple[str, ...] = (_LETTERS, _DIGITS)) -> str:
    """Permutes letters among letters and digits among digits; case and signs stay."""
    low = s.lower()
    where = [(i, next(a for a in alphabets if c in a)) for i, c in enumerate(low) if any(c in a for a in alphabets)]
    x, n = 0, 1
    for i, a in where:
        x, n = x * len(a) + a.index(low[i]), n * len(a)
    shape = "".join(next((str(k) for k, a in enumerate(alphabets) if c in a), c) for c in low)
    x = permute(x, n, key, kind + shape.encode(), inverse)
    out = list(s)
    for i, a in reversed(where):
        x, r = divmod(x, len(a))
        out[i] = a[r].upper() if s[i].isupper() else a[r]
    return "".join(out)


def _email(m: re.Match, key: bytes, inverse: bool) -> str | None:
    return _classes(m["local"], key, b"mail:" + m["host"].lower().encode(), inverse) + "@" + m["host"]


#: Digits that are permuted at once; a longer secret goes piece by piece.
_PIECE = 128


def _is_secret(s: str) -> bool:
    return any(c in _DIGITS for c in s) and any(c not in _DIGITS for c in s)


def _hex(low: str, key: bytes, inverse: bool) -> str:
    """Of small hexadecimal digits; each piece is tied to the pseudonym of the one before."""
    out, before = [], b""
    for at in range(0, len(low), _PIECE):
        piece = low[at : at + _PIECE]
        new = format(permute(int(piece, 16), 16 ** len(piece), key, b"hex" + before, inverse), "x").zfill(len(piece))
        before = b":%d:" % at + hashlib.blake2b((piece if inverse else new).encode(), digest_size=16).digest()
        out.append(new)
    return "".join(out)


def _secret(m: re.Match, key: bytes, inverse: bool) -> str | None:
    out = m[0]
    if not _is_secret(out):
        return None
    if out not in (out.lower(), out.upper()):  # mixed case: letters stay letters, each in its case
        for at in range(0, len(out), _PIECE):
            out = out[:at] + _classes(out[at : at + _PIECE], key, b"mixed:%d" % at, inverse, ("abcdef", _DIGITS)) + out[at + _PIECE :]
        return out
    small = out == out.lower()
    out = out.lower()
    while not _is_secret(out := _hex(out, key, inverse)):
        pass
    return out if small else out.upper()


def _iban(m: re.Match, key: bytes, inverse: bool) -> str | None:
    bare = m[0].replace(" ", "")
    if not 15 <= len(bare) <= 34 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
        return None
    body = _classes(bare[4:], key, b"iban" + bare[:2].encode(), inverse)
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    it = iter(bare[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in m[0])


_KINDS = (
    ("email", r"(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})@(?P<host>[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,252}[A-Za-z0-9])?\.[A-Za-z]{2,24})(?![A-Za-z0-9])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("secret", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])", _secret),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    ("date", r"(?<![\d.\-/])(?:(?P<a>\d{4})(?P<sep>[\-/.])(?P<b>\d{2})(?P=sep)(?P<c>\d{2})|(?P<a2>\d{2})(?P<sep2>[\-/.])(?P<b2>\d{2})(?P=sep2)(?P<c2>\d{4}))(?![\d\-/])(?!\.\d)", _date),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d])(?!\.\d)", _ip),
    ("card", r"(?<![\d.\-])\d(?:[ \-]?\d){12,}(?![\d])(?!-\d)", _card),
    ("phone", r"(?<![\d\w+])(?<!\d\.)(?:(?P<code>\+\d{1,3})[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\d])(?![\-.]\d)|(?<![\d\w+])(?P<code2>\+\d{1,3})\d{7,12}(?!\d)", _phone),
)
NAMES = tuple(k for k, _, _ in _KINDS)


class _Named:
    """A match whose alternative groups read under one name."""

    def __init__(self, m: re.Match):
        self.m = m

    def __getitem__(self, name):
        if name == 0:
            return self.m[0]
        groups = self.m.re.groupindex
        return self.m[name] if self.m[name] is not None or name + "2" not in groups else self.m[name + "2"]


@lru_cache(1)
def _compiled() -> tuple[tuple[str, re.Pattern, object], ...]:
    return tuple((k, re.compile(p), f) for k, p, f in _KINDS)


_HINT = re.compile(r"[0-9@]|[a-fA-F]{32}")


def pseudonymize_text(text: str, key: bytes = KEY, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and the number of values of each kind.
    An earlier kind of ``NAMES`` takes its characters from the later ones."""
    if not text or not _HINT.search(text):
        return text, {}
    taken: list[tuple[int, int, str]] = []
    counts: dict[str, int] = {}
    for kind, pattern, make in _compiled():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(s < b and a < e for a, b, _ in taken):
                continue
            new = make(_Named(m), key, inverse)
            new = [(s, e, new)] if isinstance(new, str) else [(s + a, s + b, x) for a, b, x in new or ()]
            taken += new
            if new:
                counts[kind] = counts.get(kind, 0) + len(new)
    if not taken:
        return text, counts
    taken.sort()
    out, at = [], 0
    for s, e, new in taken:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], counts


def pseudonymize(text: Column, key: bytes = KEY, inverse: bool = False) -> Column:
    """A struct ``text`` and ``n_<kind>`` for each kind; null for a null text."""
    fields = ["text", *(f"n_{k}" for k in NAMES)]

    def run(texts: pa.Array) -> pa.Array:
        rows = [pseudonymize_text(t, key, inverse) if t is not None else (None, {}) for t in texts.to_pylist()]
        columns = [pa.array([t for t, _ in rows], pa.string())] + [pa.array([c.get(k, 0) for _, c in rows], pa.int32()) for k in NAMES]
        return pa.StructArray.from_arrays(columns, fields)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<text:string," + ",".join(f"n_{k}:int" for k in NAMES) + ">")(text)


def pseudonymize_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, inverse: bool = False) -> DataFrame:
    """``doc_id, text, n_<kind>...`` for each input row.

    A null text stays null with zero counts and an empty one empty; repeated rows, equal
    values and null ids stay as they are; further columns are left out. No shuffle.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), pseudonymize(F.col(text_col).cast("string"), key, inverse).alias("__p"))
    return t.select("doc_id", "__p.*")


def replace_text(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with its text pseudonymised; columns, rows and their order as they are.

    Null and empty texts stay, repeated rows stay alike, no other column is read; an empty
    table gives an empty one. No shuffle.
    """
    return docs.withColumn(text_col, pseudonymize(F.col(text_col).cast("string"), key)["text"])
