import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilsim.llm import bpe, pii, toxicity


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.VOCABULARY)


def ids(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<i4").tolist()


def test_bpe_equals_a_public_encoder(codec):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=dict(zip(codec.words, codec.ids.tolist(), strict=True)), special_tokens={})
    rng = random.Random(3)
    texts = ["x²  ½ a_b __ 3rd ۵۶   'S don't we'll", "  \n\n a", "日本語 テスト", "a" * 500, " " * 50, "\x1c\x1d tab\t", "Ein Maß für ÄÖÜ", "aaaabbbb" * 40]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250)])) for _ in range(30)) for _ in range(300)]
    assert [ids(codec, t) for t in texts] == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_bpe_round_trip(text):
    c = bpe.codec(bpe.VOCABULARY)
    assert c.decode(ids(c, text)) == text


def test_perfect_hash_is_minimal(codec):
    h = codec.hash
    assert sorted(h.slots.tolist()) == list(range(len(codec.words)))
    assert h.find(codec.words).tolist() == list(range(len(codec.words)))


def test_merge_equals_brute_force(codec):
    rank = dict(zip(codec.words, codec.ids.tolist(), strict=True))

    def brute(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [rank[p] for p in parts]

    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdetion nsrh") for _ in range(rng.randrange(1, 40)))
        assert codec.merge(w) == brute(w)


def test_bpe_columns(docs_of):
    docs = docs_of([(1, "Hello wörld"), (2, None), (3, "")])
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs).collect()}
    assert rows[1]["round_trip"] and rows[1]["n_tokens"] == len(rows[1]["token_ids"])
    assert rows[2]["token_ids"] is None and rows[2]["n_tokens"] == 0 and rows[3]["token_ids"] == []
    from pyspark.sql import functions as F

    assert bpe.encode_documents(docs).select(bpe.decode(F.col("token_ids")).alias("t")).collect()[0]["t"] == "Hello wörld"


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 5000), st.binary(min_size=1, max_size=8))
def test_permutation(n, key):
    xs = range(0, n, max(1, n // 50))
    ys = [pii.permute(x, n, key, b"t") for x in xs]
    assert len(set(ys)) == len(ys) and all(0 <= y < n for y in ys)
    assert [pii.permute(y, n, key, b"t", inverse=True) for y in ys] == list(xs)


def test_permutation_of_a_small_domain_is_whole():
    assert sorted(pii.permute(x, 97, b"k", b"t") for x in range(97)) == list(range(97))


PERSONAL = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0187"],
    "ip": ["233.254.104.120", "8.8.4.4"],
    "email": ["und.34@mail7.example.com", "Jane.Doe@Example.org"],
    "ssn": ["123-45-6789"],
    "date": ["1987-06-05", "05.06.1987", "12/31/1999", "31/12/1999"],
    "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
}


@pytest.mark.parametrize("kind", PERSONAL)
def test_pseudonyms_keep_their_format(kind):
    import re

    for value in PERSONAL[kind]:
        text = f"see {value}, and {value} again."
        new, counts = pii.pseudonymize_text(text)
        assert counts == {kind: 2} and value not in new
        first, second = re.fullmatch(r"see (.*), and (.*) again\.", new).groups()
        assert first == second and len(first) == len(value) or kind == "ip"
        assert pii.pseudonymize_text(new, inverse=True)[0] == text
        if kind == "card":
            d = "".join(c for c in first if c.isdigit())
            assert pii.luhn_digit(d[:-1]) == d[-1] and "4111111111111111" != d
    assert pii.pseudonymize_text("4111-1111-1111-1111")[0].replace("-", "") == pii.pseudonymize_text("4111111111111111")[0]


def test_no_personal_data_no_change():
    for text in ("version 3.", "CC BY-NC 4.0", "in 1999 and 2001", "4111111111111112", "999.1.1.1", "2021-13-45", "a@b", "1 2 3 4 5", "000-12-3456", "10 000 000 people", ""):
        assert pii.pseudonymize_text(text) == (text, {})


def test_toxicity_folds_and_excepts():
    m = toxicity.Matcher()
    for text in ("you idiot", "you 1d10t!", "you IDIOTS!!", "you іdіоt", "ｉｄｉｏｔ", "you id​iot", "ídíot", "idiot$$$"):
        assert m.measure(text)[0] == 1, text
    for text in ("idiotic", "the trash can", "a clown fish", "scunthorpe", "moronic acid", "", None, "the glass"):
        assert m.measure(text)[0] == 0, text
    assert m.measure("trash can trash")[0] == 1
    assert toxicity.Matcher({}, ()).measure("idiot") == (0, 0.0)


def test_toxicity_is_relative_to_length(docs_of):
    long = "word " * 5000
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs_of([(1, "idiot and moron " + "word " * 20), (2, "idiot moron " + long), (3, long), (4, "one stupid word")])).collect()}
    assert [rows[i]["toxic"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert rows[1]["score"] > rows[2]["score"] > 0


def test_stems_are_learnt_from_labels(spark, docs_of):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 60) + (" gröblich gröbheit gröbung" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")
    stems = dict(toxicity.learn_stems(docs_of(rows), labels))
    assert any(s.startswith("gröb") for s in stems)
    out = {r["doc_id"]: r["toxic"] for r in toxicity.score_documents(docs_of(rows), labels).collect()}
    held_out = range(120, 200)
    assert sum(out[i] == bool(i % 2) for i in held_out) >= 0.95 * len(held_out)
