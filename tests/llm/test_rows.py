"""Every operator on awkward rows and on empty tables."""

import pytest

from tilsim.llm import bpe, ctw, media, mixing, pii, quality_classifier, quality_rules, simhash, substring, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (7, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


ONE_ROW_EACH = {
    "bpe": lambda d, _: bpe.encode_documents(d),
    "classifier": lambda d, l: quality_classifier.classify(d, l),
    "pii": lambda d, _: pii.pseudonymize_documents(d),
    "rules": lambda d, _: quality_rules.apply_policies(quality_rules.ledger(d)),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "toxicity": lambda d, l: toxicity.score_documents(d, l),
    "lm": lambda d, _: ctw.score(d),
    "media": lambda d, _: media.media_columns(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each(name, awkward, nothing, labels, no_labels):
    rows = ONE_ROW_EACH[name](awkward, labels).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(map(key, rows)) == sorted((i is None, i or 0) for i in (1, 1, 2, None, 3, 4, 5, 6, None, 7, 8))
    assert ONE_ROW_EACH[name](nothing, no_labels).count() == 0
    assert ONE_ROW_EACH[name](awkward, no_labels).count() == 11


def test_substring_rows(awkward, nothing):
    rows = substring.repeats(awkward).collect()
    assert {(r["doc_id"], r["start"], r["n_occurrences"], r["first_doc_id"]) for r in rows} == {(4, 0, 2, 4), (8, 0, 2, 4)}
    assert substring.repeats(nothing).count() == 0


def test_mixing_rows(awkward, nothing):
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert mixing.mix(nothing).count() == 0
    doubled = mixing.mix(awkward, budget=2.0, temper=1.0)
    assert doubled.count() == 22


def test_filters_keep_columns(awkward, nothing, labels):
    for f in (lambda d: toxicity.drop_toxic(d, labels), simhash.drop_near_duplicates, pii.replace_text):
        assert f(awkward).columns == awkward.columns
        assert f(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1 stands for its copies and for 6; 2 for the texts that are null or empty; 4 for 8
    assert ids == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 7), (True, 0)]
