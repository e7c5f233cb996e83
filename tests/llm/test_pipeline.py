"""The pipeline against a brute-force version of its stages, and the rules' SQL."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tilsim.llm import bpe, mixing, pii, quality_classifier, quality_rules, queries, simhash, toxicity
from tilsim.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_pipeline_against_brute_force(spark, duck):
    docs = duck.sql("SELECT * FROM documents ORDER BY doc_id").df()
    stems = tuple(toxicity.learn_stems(table(spark, SF, "documents"), table(spark, SF, "labels")))
    matcher = toxicity.Matcher(None, toxicity.EXCEPTIONS, stems)

    def toxic(t):
        hits, weight = matcher.measure(t)
        return 1000 * weight / max(len(t), toxicity.LEAST_CHARS) >= toxicity.THRESHOLD and (hits >= toxicity.LEAST_HITS or weight >= toxicity.LEAST_WEIGHT)

    kept = docs[[not toxic(t) for t in docs.text]].reset_index(drop=True)
    assert 0 < len(kept) < len(docs)
    m = np.frombuffer(b"".join(simhash.sketches(kept.text.tolist())), np.uint64).reshape(len(kept), -1)
    near = np.bitwise_count(m[:, None, :] ^ m[None, :, :]).sum(axis=2) <= simhash.DISTANCE
    group = np.arange(len(kept))
    while True:
        least = np.array([group[near[i]].min() for i in range(len(kept))])
        if (least == group).all():
            break
        group = least
    kept = kept[group == np.arange(len(kept))].reset_index(drop=True)  # doc_id ascends
    kept["text"] = [pii.pseudonymize_text(t)[0] for t in kept.text]
    mixed = duck.sql(mixing.MIX_SQL.replace("FROM documents", "FROM kept").replace("documents.", "kept.")).df()
    codec = bpe.codec(bpe.VOCABULARY)
    want = sorted((int(i), np.frombuffer(p, "<i4").tolist()) for i, p in zip(mixed.doc_id, codec.encode(mixed.text.tolist()), strict=True))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["token_ids"]) for r in rows) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_mixing_meets_its_weights(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    weights = {"src0": 0.5, "src1": 0.25, "src2": 0.25}
    out = mixing.mix(docs, weights, details=True).groupBy("source").sum("n_tokens").collect()
    total = sum(r[1] for r in out)
    assert {r[0] for r in out} == set(weights)
    for r in out:
        assert abs(r[1] / total - weights[r[0]]) < 0.05


def test_mixing_by_either_join(spark):
    docs = table(spark, SF, "documents")
    rows = lambda most: sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(docs, details=True, most_sent=most).collect())
    assert rows(0) == rows(100)


def test_classifier_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = quality_classifier.classify(docs, train).join(held, "doc_id").select("quality", "keep", "score").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["keep"] for r in good) >= 0.98 * len(good)
    assert np.mean([r["score"] for r in good]) > 0.95 > 0.6 > np.mean([r["score"] for r in bad])


def test_sparse_sites_shrink_to_the_prior(spark, docs_of):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 30), "en", f"s{i % 3}") for i in range(90)] + [(1000, prose(1000, 30), "en", "lonely")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs_of(rows), labels).collect()}
    assert out[0]["host_rate"] < 0.2 and out[1]["host_rate"] > 0.8 and 0.4 < out[1000]["host_rate"] < 0.9


def test_ablation_counts(spark, docs_of):
    led = quality_rules.ledger(docs_of([(1, "A" * 50), (2, "fine words here and there"), (3, "a # $ % & * b " * 9), (4, "")]))
    got = {(r["policy"], r["rule"]): (r["n_failed"], r["n_failed_only_this"]) for r in quality_rules.ablation(led).collect()}
    assert got["v1", "empty"] == (1, 1) and got["v1", "upper_heavy"] == (1, 1) and got["v2", "symbol_heavy"][0] == 1
    kept = {r["doc_id"]: r["keep"] for r in quality_rules.apply_policies(led).collect()}
    assert kept == {1: False, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, awkward, nothing, stage):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = run(spark, awkward, SF)
    got = out.collect()
    assert run(spark, nothing, SF).count() == 0
    if stage == "bpe":
        codec = bpe.codec(bpe.VOCABULARY)
        assert sorted(((r["doc_id"], codec.decode(r["token_ids"]) if r["token_ids"] is not None else None) for r in got), key=repr) == sorted(rows, key=repr)
        return
    assert out.columns == awkward.columns
    left = [(r["doc_id"], r["text"]) for r in got]
    if stage in ("toxicity", "pii"):  # nothing here is toxic or personal
        assert sorted(left, key=repr) == sorted(rows, key=repr)
    elif stage == "near_duplicates":
        assert sorted({t for _, t in left}, key=repr) == sorted({t or None for _, t in rows} - {None} | {None}, key=repr)
        assert sorted((i is None, i or 0) for i, _ in left) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 7), (True, 0)]
    else:
        assert set(left) <= set(rows)
        for i, t in set(left):  # repeated rows draw alike
            assert left.count((i, t)) % rows.count((i, t)) == 0
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else r["n_chars"]) for r in got)


def test_pseudonyms_without_a_count_of_characters(spark, awkward):
    out = corpus_pipeline.pseudonymize(spark, awkward.drop("n_chars"), SF)
    assert "n_chars" not in out.columns and out.count() == awkward.count()
