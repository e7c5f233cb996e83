from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilsim.operators import spelling

NAMES = ["red bolt", "red bold", "hot ring", "hot rings", None]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_pairs_of_rows_by_blocks(spark, monkeypatch, block):
    """Every pair once, whatever the blocks; a word's pairs are dealt to several tasks."""
    monkeypatch.setattr(spelling, "TASK_PAIRS", 2_000)
    rows = [(k, NAMES[0] if k < 90 else NAMES[k % 5]) for k in range(120)] + [(3, NAMES[0]), (3, NAMES[1]), (None, NAMES[0])]
    table = spark.createDataFrame(rows, "key int, name string")
    near = spelling.similar(table, table, 1.0, "name", "name")
    made = spelling.row_pairs(table, near, "key", "name", block)
    close = lambda a, b: a and b and spelling.weighted_distance(a, b) <= 1
    want = Counter((a, b) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and close(x, y))
    assert Counter(map(tuple, made.collect())) == want
    if block < 90:
        assert made.select(F.spark_partition_id()).distinct().count() > 1


def test_no_pairs(spark):
    table = spark.createDataFrame([], "key int, name string")
    assert spelling.row_pairs(table, spelling.similar(table, table, 1.0, "name", "name"), "key", "name").count() == 0
