"""Personal data against an independent reader, and whole domains one to one."""

import datetime as dt
import ipaddress
import random

import pytest

from tests.llm.conftest import prose
from tilsim.llm import pii


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def made(rng):
    """A value, its kind or None if it is none, by a grammar of values."""
    kind = rng.choice(["card", "ssn", "ip", "date", "email", "secret", "phone", "number"])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        d = rng.choice("456") + digits(rng.choice([14, 15, 15, 15]))
        d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c)) if rng.random() < 0.7 else d
        shape = rng.choice(["{0}", "{1}-{2}-{3}-{4}"]) if len(d) == 16 and luhn(d) else "{0}"  # four groups that are no card may hold a phone number
        return shape.format(d, d[:4], d[4:8], d[8:12], d[12:]), "card" if luhn(d) and len(set(d)) > 1 else None
    if kind == "ssn":
        a, b, c = rng.choice(["000", digits(3)]), rng.choice(["00", digits(2)]), rng.choice(["0000", digits(4)])
        return f"{a}-{b}-{c}", "ssn" if a != "000" and b != "00" and c != "0000" else None
    if kind == "ip":
        v = ".".join(str(rng.randrange(280)) for _ in range(4))
        try:
            ip = ipaddress.IPv4Address(v)
        except ValueError:
            return v, None
        return v, "ip" if not ip.is_loopback and int(ip) >> 24 and len({*ip.packed}) > 1 else None
    if kind == "date":
        form, (y, m, d) = rng.choice(["{0}-{1}-{2}", "{2}.{1}.{0}", "{1}/{2}/{0}"]), (digits(4), f"{rng.randrange(1, 14):02d}", f"{rng.randrange(1, 33):02d}")
        v = form.format(y, m, d)
        for f in ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"] + (["%d/%m/%Y"] if "/" in v and int(v[:2]) > 12 else []):
            try:
                dt.datetime.strptime(v, f)
            except ValueError:
                continue
            return v, "date"
        return v, None
    if kind == "email":
        return prose(rng.random(), 1).replace("é", "e") + digits(2) + "@" + rng.choice(["mail.example.org", "x.de"]), "email"
    if kind == "secret":
        n = rng.choice([31, 32, 40, 64, 128, 129, 300])
        v = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        v = rng.choice([v, v.upper(), "".join(rng.choice([c, c.upper()]) for c in v)])
        return v, "secret" if n >= 32 else None
    if kind == "phone":
        return f"({digits(3)}) {digits(3)}-{digits(4)}", "phone"
    return digits(rng.choice([1, 4, 8, 12])), None


@pytest.mark.parametrize("seed", range(4))
def test_values_are_found_replaced_and_come_back(seed):
    rng = random.Random(seed)
    for _ in range(250):
        parts = [made(rng) for _ in range(rng.randrange(1, 6))]
        words = [prose(rng.random(), 2) for _ in parts]
        text = " ".join(f"{w} <{v}>" for w, (v, _) in zip(words, parts, strict=True))
        new, counts = pii.pseudonymize_text(text, b"k")
        want = {}
        for _, kind in parts:
            if kind:
                want[kind] = want.get(kind, 0) + 1
        assert counts == want, text
        values = [x.partition(">")[0] for x in new.split("<")[1:]]
        for (v, kind), n in zip(parts, values, strict=True):
            assert (n != v) == (kind is not None)
            shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
            assert kind in ("ip", "email", "secret") or shape(n) == shape(v)
        again, same = pii.pseudonymize_text(new, b"k")
        assert same == want  # the pseudonyms validate
        assert pii.pseudonymize_text(new, b"k", inverse=True)[0] == text


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"])
@pytest.mark.parametrize("years", [(1900, 2100), (1650, 1900)])
def test_dates_are_permuted_one_to_one(form, years):
    every = [dt.date.fromordinal(n) for n in range(dt.date(years[0], 1, 1).toordinal(), dt.date(years[1], 1, 1).toordinal(), 7)]
    dates = [d.strftime(form) for d in every if form != "%d/%m/%Y" or d.day > 12]
    new = [pii.pseudonymize_text(d)[0] for d in dates]
    assert len(set(new)) == len(dates)
    assert [pii.pseudonymize_text(d, inverse=True)[0] for d in new] == dates


def test_no_two_short_secrets_or_numbers_meet():
    ips = [f"{a}.{b}.9.{c}" for a in (1, 126, 128) for b in range(12) for c in range(100)]
    ssns = [f"{n:03d}-01-{n:04d}" for n in range(1, 1000)]
    for values in (ips, ssns):
        new = [pii.pseudonymize_text(v)[0] for v in values]
        assert len(set(new)) == len(values)
        assert [pii.pseudonymize_text(v, inverse=True)[0] for v in new] == values


@pytest.mark.parametrize("text", ["4111111111111111 123", "4111111111111111 12/25", "No 12 4111 1111 1111 1111", "4111 1111 1111 1111 5500 0000 0000 0004", "2024 4111-1111-1111-1111 7", "5500000000000004 4111111111111111"])
def test_a_card_beside_other_digits(text):
    new, counts = pii.pseudonymize_text(text)
    assert counts["card"] == text.count("4111") // max(1, text.count("4111")) + ("5500" in text)
    assert "4111" not in new or "1111" not in new
    assert pii.pseudonymize_text(new, inverse=True)[0] == text
