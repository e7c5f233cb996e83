import itertools
import random

import pytest
from pyspark.sql import functions as F

from tilsim.operators import hmm
from tilsim.plans import catalogue

SF = "/root/testdata/sf0.001"


def _nodes(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_tokens(spark):
    """Neither transitions nor log-probabilities gather a state's or text's tokens in a window."""
    for name in ("transition_logprob", "emission_logprob"):
        assert "Window" not in _nodes(catalogue.queries()[name](spark, SF))


@pytest.mark.parametrize("held", [8, 1 << 22])
def test_likeliest_path_against_all_paths(spark, monkeypatch, held):
    """Sentences of unequal lengths and candidates, with places that occur twice."""
    monkeypatch.setattr(hmm, "_HELD", held)
    rng = random.Random(5)
    em = [(p, s, -rng.random() * 9) for p in "ABC" for s in "wxyz" if rng.random() < 0.8]
    tr = [(a, b, -rng.random() * 9) for a in ["A", "B", "C", hmm.START] for b in ["A", "B", "C", hmm.END] if rng.random() < 0.8]
    tokens = [(n, i, rng.choice("wxyzV"), rng.sample(["A", "B", "C"], rng.randint(0, 3))) for n in range(40) for i in range(rng.randint(1, 5))]
    tokens += [(50, 0, "w", ["A"]), (50, 1, "x", ["A", "B"]), (50, 1, "y", ["C"]), (50, 2, "z", ["B", "C"])]
    got = hmm.viterbi(spark.createDataFrame(tokens, "sent_id int, idx int, surface string, candidates array<string>"), spark.createDataFrame(em, "pos string, surface string, log_prob double"), spark.createDataFrame(tr, "prev string, next string, log_prob double")).collect()
    emitted, hop = {(p, s.lower()): v for p, s, v in em}, {(a, b): v for a, b, v in tr}
    lines = {}
    for n, i, s, cand in tokens:
        lines.setdefault(n, {}).setdefault(i, []).extend((p, emitted.get((p, s.lower()), hmm.UNKNOWN)) for p in cand or [hmm.END])
    want = set()
    for n, places in lines.items():
        def value(path):
            steps = [hmm.START, *(p for p, _ in path), hmm.END]
            return sum(lp for _, lp in path) + sum(hop.get(x, hmm.UNKNOWN) for x in itertools.pairwise(steps))
        best = max(itertools.product(*places.values()), key=value)
        want |= {(n, i, None if p == hmm.END else p) for i, (p, _) in zip(places, best, strict=True)}
    assert len(got) == len(want) and {(r.sent_id, r.idx, r.pos) for r in got} == want


def test_transitions_of_lists(spark):
    """As of rows of tokens, with ids that repeat, empty and null texts."""
    rows = [(1, [0, 1, 2]), (1, [0, 1, 2]), (2, [2]), (3, []), (4, None), (None, [1, 1])]
    lists = spark.createDataFrame(rows, "sent_id int, codes array<tinyint>")
    each = lists.select("sent_id", F.posexplode("codes").alias("idx", "c")).select("sent_id", "idx", F.get(F.array(*map(F.lit, "SML")), F.col("c").cast("int")).alias("pos"))
    assert sorted(hmm.transition_counts_of(lists, "codes", tuple("SML")).collect()) == sorted(hmm.transition_counts(each).collect())
