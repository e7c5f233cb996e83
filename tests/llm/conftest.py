import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "or", "ent", "is", "ri", "ou", "lk", "vé", "st"]) for _ in range(rng.randrange(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=()):
        """rows of (doc_id, text) or (doc_id, text, lang, source); extra: clashing columns."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        schema = DOCS + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    clash = ["tokens", "ids", "rate", "copy_no", "score", "keep", "sk", "root", "block", "bucket", "digest", "__row", "hits", "fail_bits"]
    long = prose(5, 30_000)
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (None, "some text of a row without id"), (3, ""), (4, long), (5, "   \n\n"), (6, "a b c d", None, None), (None, None, None, None), (7, "!!!"), (8, long)]
    return docs_of(rows, clash)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
