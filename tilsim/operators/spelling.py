"""Spelling: validity, weighted distance and suggestions.

A weighted distance is at least the plain one between the words with their Turkish letters
folded, so a join keeps pairs within it by Spark's own bounded ``levenshtein`` and only
those go on to the exact distance. Pairs are found by equality first: words share a
signature that some deletion of at most as many letters leaves, which makes the similarity
join an equi join instead of a product.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilsim.functions import grammar as g
from tilsim.functions.words import tr_lower
from tilsim.operators import analyze as an
from tilsim.plans.staging import staged

LONGEST = 200
_FOLD, _PLAIN = "ıöüşçğ", "iouscg"
_HALF = frozenset(frozenset(p) for p in zip(_FOLD, _PLAIN, strict=True))
_REMADE = tuple("conjugate decline copula converb converb_casina converb_ken participle with_ki".split())


def weighted_distance(a: str, b: str) -> float:
    """Levenshtein with half a step between the two letters of ı/i, ö/o, ü/u, ş/s, ç/c, ğ/g."""
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            step = 0.0 if x == y else 0.5 if frozenset((x, y)) in _HALF else 1.0
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + step)
    return row[-1]


def distance(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else weighted_distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def folded(c: Column) -> Column:
    return F.translate(c, _FOLD, _PLAIN)


def _signatures(word: Column, edits: int) -> Column:
    """What deleting up to ``edits`` letters leaves."""

    def run(words: pa.Array) -> pa.Array:
        out = []
        for w in words.to_pylist():
            level = {w} if w is not None else set()
            found = set(level)
            for _ in range(edits):
                level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
                found |= level
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(word)


def similar(words: DataFrame, lexicon: DataFrame, max_distance: float = 2.0, word: str = "word", lemma: str = "lemma") -> DataFrame:
    """``word, lemma, distance`` of all pairs within ``max_distance``, all words queried."""
    if max_distance <= 0:
        raise ValueError("max_distance must be positive")
    edits = int(max_distance)
    left = words.select(F.col(word).alias("word")).filter(F.length("word").between(1, LONGEST)).distinct().withColumn("sig", F.explode(_signatures(folded(F.col("word")), edits)))
    right = lexicon.select(F.col(lemma).alias("lemma")).filter("lemma IS NOT NULL").distinct().withColumn("sig", F.explode(_signatures(folded(F.col("lemma")), edits)))
    pairs = left.join(right, "sig").select("word", "lemma").distinct()
    near = pairs.filter(F.levenshtein(folded(F.col("word")), folded(F.col("lemma")), edits) >= 0)
    return near.withColumn("distance", distance(F.col("word"), F.col("lemma"))).filter(F.round(F.col("distance") * 2) <= round(max_distance * 2))


#: Rows of one word are dealt to blocks of about so many, as generated code holds all pairs of
#: two blocks at once; pairs and pairs of blocks are dealt to tasks of about so many.
BLOCK, TASK_PAIRS, TASK_BLOCKS = 1024, 100_000_000, 200_000


def row_pairs(rows: DataFrame, near: DataFrame, key: str, word: str = "word", block: int = BLOCK) -> DataFrame:
    """``left_key, right_key``: every two rows whose words ``near`` (word, lemma) pairs, the
    lesser key first; equal keys and nulls make no pair.

    There are as many pairs as the words repeat squared. They are made from pairs of blocks
    of keys, dealt evenly to tasks, so that no task holds more than some blocks and none
    makes all the pairs of a frequent word.
    """
    keys = rows.select(F.col(word).alias("word"), F.col(key).alias("key")).filter("word IS NOT NULL AND key IS NOT NULL")
    near = staged(near.select("word", "lemma"), "spelling-near")
    sizes = keys.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = keys.withColumn("at", F.monotonically_increasing_id()).join(sizes, "word").groupBy("word", (F.col("at") % F.col("blocks")).alias("at")).agg(F.collect_list("key").alias("keys"))
    blocks = staged(dealt.select("word", "keys"), "spelling-blocks")
    of = lambda name: blocks.groupBy(F.col("word").alias(name)).agg(F.sum(F.size("keys").cast("bigint")).alias(f"{name}_n"), F.count(F.lit(1)).alias(f"{name}_blocks"))
    total = near.join(of("word"), "word").join(of("lemma"), "lemma").agg(F.sum(F.col("word_n").cast("double") * F.col("lemma_n")), F.sum(F.col("word_blocks").cast("double") * F.col("lemma_blocks"))).first()
    tasks = 1 + int((total[0] or 0) // TASK_PAIRS + (total[1] or 0) // TASK_BLOCKS)
    both = near.join(blocks.withColumnRenamed("keys", "left"), "word").join(blocks.select(F.col("word").alias("lemma"), F.col("keys").alias("right")), "lemma")
    made = both.select("left", "right").repartition(min(tasks, 100_000)).select(F.explode("left").alias("left_key"), "right")
    return made.select("left_key", F.explode("right").alias("right_key")).filter("left_key < right_key")


def is_valid(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """``word, is_valid`` per distinct word: whether some reading with a known lemma exists."""
    w = words.select(F.col(word).alias("word")).distinct()
    low = w.withColumn("surface", tr_lower(F.trim("word")))
    seen = an.analyze(low, lexicon)
    ok = F.exists("readings", lambda r: ~r["hypothetical"]) & (F.length("surface") <= LONGEST) & (F.length("surface") > 0)
    return low.join(seen, "surface", "left").select("word", F.coalesce(ok, F.lit(False)).alias("is_valid"))


def suggest(words: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, max_suggestions: int = 5, max_distance: float = 2.0, word: str = "word") -> DataFrame:
    """``word, suggestion, distance, rank``: lemmas near the word, and forms of lemmas near
    those of its readings; by distance, frequency and name, the first ``max_suggestions``."""
    if max_suggestions < 1:
        raise ValueError("max_suggestions must be at least 1")
    w = words.select(F.col(word).alias("word")).distinct().withColumn("low", tr_lower(F.trim("word"))).filter(F.length("low").between(1, LONGEST))
    w = staged(w, "spelling-words")
    direct = similar(w, lexicon, max_distance, "low").select(F.col("word").alias("low"), F.col("lemma").alias("suggestion"), "distance", F.lit(0).alias("way"))
    told = an.reading_rows(an.analyze(w, None, "low")).filter(F.col("kind").isin(*_REMADE)).select(F.col("surface").alias("low"), "ord", F.col("lemma").alias("lemma0"), "kind", "axes")
    told = staged(told, "spelling-told")
    near = similar(told, lexicon, max_distance, "lemma0").select(F.col("word").alias("lemma0"), "lemma", "distance")
    remade = told.join(near, "lemma0").withColumn("suggestion", _remake(F.struct("lemma", "kind", "axes"))).filter("suggestion IS NOT NULL").select("low", "suggestion", "distance", F.lit(1).alias("way"))
    # a suggestion keeps the distance of the first way that found it
    both = direct.unionByName(remade).groupBy("low", "suggestion").agg(F.min(F.struct("way", "distance")).alias("first")).select("low", "suggestion", "first.distance")
    both = both.join(freq.select(F.col("lemma").alias("suggestion"), F.col("n").alias("__n")), "suggestion", "left") if freq is not None else both.withColumn("__n", F.lit(0))
    place = F.row_number().over(Window.partitionBy("low").orderBy("distance", F.coalesce("__n", F.lit(0)).desc(), "suggestion"))
    return w.join(both.withColumn("rank", place).filter(F.col("rank") <= max_suggestions), "low").select("word", "suggestion", "distance", "rank")


def _remake(reading: Column) -> Column:
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            axes = {k: v for k, v in r["axes"].items() if v is not None}
            if "converb_kind" in axes or r["kind"] == "participle":
                axes["kind"] = axes.pop("converb_kind", None) or axes.pop("ptype", None)
            try:
                out.append(getattr(g, r["kind"])(r["lemma"], **axes))
            except (ValueError, TypeError, IndexError):
                out.append(None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(reading)


def check(words: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, max_suggestions: int = 5, max_distance: float = 2.0, word: str = "word") -> DataFrame:
    """``word, is_valid, suggestions`` per distinct word; a valid word has no suggestions."""
    valid = staged(is_valid(words, lexicon, word), "spelling-valid")
    made = suggest(valid.filter(~F.col("is_valid")), lexicon, freq, max_suggestions, max_distance)
    lists = made.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))), lambda s: s["suggestion"]).alias("suggestions"))
    return valid.join(lists, "word", "left").select("word", "is_valid", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
