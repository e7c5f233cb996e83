"""Lemmas of words and of the tokens of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilsim.functions.grammar import _PRONOUNS
from tilsim.operators import analyze as an
from tilsim.operators import ranking, spelling
from tilsim.plans.staging import staged

_OBLIQUE = {form: base for base, forms in reversed(_PRONOUNS.items()) for form in forms.values()}
_SIGNS = "^[\\p{P}\\p{S}\\p{Z}]*$"


def _table(values: dict):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _resolved(words: DataFrame, lexicon: DataFrame, freq: DataFrame | None, corrected: bool) -> DataFrame:
    """``word, lemma, pos, confidence, corrected`` of the words that have a lemma."""
    w = words.select("word").distinct().filter(~F.col("word").rlike(_SIGNS))
    oblique = w.select("word", _table(_OBLIQUE)[F.lower("word")].alias("lemma"))
    known = oblique.filter("lemma IS NOT NULL").select("word", "lemma", F.lit("noun").alias("pos"), F.lit(1.0).alias("confidence"))
    rest = oblique.filter("lemma IS NULL").select(F.col("word").alias("surface"))
    rest = staged(rest, "lemma-words")
    rows = an.reading_rows(an.analyze(rest, lexicon))
    best = ranking.disambiguate(rows, ["surface"], freq).filter("rank = 1").select(F.col("surface").alias("word"), "lemma", "pos", "confidence")
    best = staged(best, "lemma-best")
    # a phrase without a reading of known lemmas is read anyway; the most parts win, then a
    # lemma whose last word is known
    phrases = rest.filter(F.instr("surface", " ") > 0).join(best.select(F.col("word").alias("surface")), "surface", "left_anti")
    free = ranking.disambiguate(an.reading_rows(an.analyze(phrases, None)), ["surface"], freq)
    ends = lexicon.select(F.col("lemma").alias("__end")).distinct().withColumn("__known", F.lit(1))
    free = free.withColumn("__end", F.element_at(F.split("lemma", " "), -1)).join(ends, "__end", "left")
    order = Window.partitionBy("surface").orderBy(F.size("segments").desc(), F.coalesce("__known", F.lit(0)).desc(), "rank")
    free = free.withColumn("__place", F.row_number().over(order)).filter("__place = 1").select(F.col("surface").alias("word"), "lemma", "pos", "confidence")
    return known.unionByName(best).unionByName(free).withColumn("corrected", F.lit(corrected))


def lemmatize(words: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, word: str = "word") -> DataFrame:
    """``word, lemma, pos, confidence, corrected`` per distinct word; nulls where nothing
    is found. Punctuation has no lemma; oblique pronouns have theirs at once; a word without
    readings is tried once more as its first spelling suggestion."""
    w = words.select(F.trim(F.col(word)).alias("word")).filter("word != ''").distinct()
    w = staged(w, "lemma-words")
    first = staged(_resolved(w, lexicon, freq, False), "lemma-first")
    open_ = staged(w.join(first, "word", "left_anti").filter(~F.col("word").rlike(_SIGNS)), "lemma-open")
    tried = spelling.suggest(open_, lexicon, freq, max_suggestions=5).filter("rank = 1").select(F.col("word").alias("__typo"), F.col("suggestion").alias("word"))
    tried = staged(tried, "lemma-tried")
    second = tried.join(_resolved(tried, lexicon, freq, True), "word").select(F.col("__typo").alias("word"), "lemma", "pos", "confidence", "corrected")
    return w.join(first.unionByName(second), "word", "left")


def lemmatize_text(texts: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id_col>, idx, token, lemma, pos, confidence, corrected`` per token, ranked among
    its neighbours; tokens without readings go the way of single words."""
    tokens = staged(an.parse_text(texts, lexicon, id_col, text), "lemma-tokens")
    rows = an.reading_rows(tokens)
    sure = ranking.disambiguate(rows, [id_col, "idx"], freq).select(id_col, "idx", "ord", "confidence")
    ranked = ranking.rank_in_context(tokens.select(id_col, "idx", "token"), rows, id_col, "idx", "token", freq).filter("rank = 1")
    best = ranked.join(sure, [id_col, "idx", "ord"]).select(id_col, "idx", "lemma", "pos", "confidence", F.lit(False).alias("corrected"))
    none = tokens.filter(F.size("readings") == 0).select(id_col, "idx", F.col("token").alias("word"))
    rest = none.join(lemmatize(none, lexicon, freq), "word", "left").select(id_col, "idx", "lemma", "pos", "confidence", "corrected")
    return tokens.select(id_col, "idx", "token").join(best.unionByName(rest), [id_col, "idx"], "left")


def lemma_lists(lemmas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text: its lemmas in order, nulls for tokens without one."""
    return lemmas.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lemma"))), lambda x: x["lemma"]).alias("lemmas"))
