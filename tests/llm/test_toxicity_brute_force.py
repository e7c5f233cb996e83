"""The automaton against a search of every term at every place, and stems of small label sets."""

import random

import pytest

from tilsim.llm import toxicity


def brute_force(text, lexicon, exceptions, stems):
    """Every term at every place; of overlapping ones the longest, then the heaviest, then the first."""
    bare, folded = toxicity.fold(text or "")
    terms = {}
    for term, weight in lexicon.items():
        for ending in toxicity.ENDINGS:
            key = toxicity.fold(term + ending)[1]
            terms[key] = max(weight, terms.get(key, (0.0, None))[0]), None
    for stem, weight in stems:
        terms.setdefault(toxicity.fold(stem)[1], (weight, stem.lower()))
    for phrase in exceptions:
        terms[toxicity.fold(phrase)[1]] = 0.0, None
    found = []
    for at in range(len(folded)):
        for key, (weight, stem) in terms.items():
            end = at + len(key)
            if folded.startswith(key, at) and (at == 0 or not bare[at - 1].isalpha()):
                whole = end == len(bare) or not bare[end].isalpha()
                if toxicity._written(bare[at:end], stem) if stem else whole:
                    found.append((-len(key), -weight, at, end))
    taken, hits, total = set(), 0, 0.0
    for _, weight, at, end in sorted(found):
        if not taken & set(range(at, end)):
            taken |= set(range(at, end))
            if weight:
                hits, total = hits + 1, total - weight
    return hits, total


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    lexicon = {"ab": 1.0, "abba": 0.5, "ba a": 2.0, "b": 0.25, "idiot": 1.0}
    exceptions, stems = ("ab ba", "an idiot"), (("bab", 0.75), ("abc", 0.4))
    m = toxicity.Matcher(lexicon, exceptions, stems)
    swaps = {"a": "a4@а", "b": "b8B", "i": "i1!", "o": "o0о", "c": "c", "d": "d", "t": "t7", " ": " -\n"}
    some = 0
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "b", "a", " ", "c", "idiot", "an "]) for _ in range(rng.randrange(0, 14)))
        text = "".join(rng.choice(swaps.get(c, c)) if rng.random() < 0.3 else c for c in text)
        hits, weight = m.measure(text)
        want = brute_force(text, lexicon, exceptions, stems)
        assert hits == want[0] and abs(weight - want[1]) < 1e-9, text
        some += hits
    assert some > 500


@pytest.mark.parametrize("n", [16, 40, 400])
def test_a_stem_that_no_clean_document_has(spark, docs_of, n):
    rows = [(i, f"word number{i} here " + ("gröblich gröbheit" if i % 2 else "schön schönheit" if i % 4 else "klar klarheit")) for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id bigint, toxic int")
    assert [s for s, _ in toxicity.learn_stems(docs_of(rows), labels)] == (["gröb"] if n > 16 else [])


def test_ties_of_labels(spark, docs_of):
    rows = [(i, "gröblich gröbheit" if i % 2 else "schön wort") for i in range(60)]
    labels = spark.createDataFrame([(i, y) for i in range(60) for y in (0, 1) if i % 2 or y == 0], "doc_id bigint, toxic int")
    assert [s for s, _ in toxicity.learn_stems(docs_of(rows), labels)] == ["gröb"]


def test_copies_of_one_text_teach_nothing(spark, docs_of):
    rows = [(i, "gröblich gröbheit wort" + (" plitz plitzend" if i % 2 and i < 14 else "") if i % 2 else f"schön wort{i}") for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id bigint, toxic int")
    assert [s for s, _ in toxicity.learn_stems(docs_of(rows), labels)] == ["gröb"]
