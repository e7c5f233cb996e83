"""Every query of the catalogue that SQL can express, against DuckDB; the rest run."""

import os

import pytest

from tilsim.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toArrow(), duck.sql(catalogue.oracle_sql()[name]).arrow().read_all()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["analyze_seed", "conjugate_paradigm", "dependency_seed", "entity_spans_seed", "ipa_tokens", "viterbi_conversations"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
