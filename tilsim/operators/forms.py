"""Word formation over columns and tables.

Numerals, particles and reduplication are Column expressions. The other generators are
Arrow UDFs over the string grammar: one batch in, one batch out. Tables of a whole paradigm
are cross joins with a small grid of cells, whose size doesn't depend on the data.
"""

from __future__ import annotations

import inspect
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilsim.functions import grammar as g
from tilsim.functions.particles import NATIVE

#: Name, and the positional parameters of the generator. Others are named axes.
GENERATORS = {
    name: [p.name for p in inspect.signature(getattr(g, name)).parameters.values() if p.kind is p.POSITIONAL_OR_KEYWORD]
    for name in (
        "conjugate compound converb converb_casina converb_ken participle decline predicative copula with_ki equative intensify diminutive adverb ordinal distributive "
        "conjoin coordinate postposition full_reduplicate converb_reduplicate m_reduplicate possessive_phrase adjective_phrase clause noun_phrase postposition_phrase "
        "degree_phrase coordinate_phrase inflect_last_token"
    ).split()
}


def form(generator: str, *args: Column | str, strict: bool = False, **axes) -> Column:
    """The form that ``generator`` makes of Columns; axes may be Columns or plain values.

    Plain axes of unknown names or values fail here, on the driver. A row that has no such
    form (a vowelless word, an impossible cell, a null word) gives null, or an error with
    ``strict``.
    """
    positional = GENERATORS[generator]
    func = getattr(g, generator)
    given = dict(zip(positional, args, strict=False)) | axes
    constant = {k: v for k, v in axes.items() if not isinstance(v, Column)}
    for k, v in constant.items():
        _check_axis(k, v)
    columns = {k: (F.col(v) if isinstance(v, str) else v) for k, v in given.items() if k not in constant}
    names = list(columns)
    if generator in NATIVE and set(given) <= set(positional):
        made = NATIVE[generator](**columns, **{k: F.lit(v) for k, v in constant.items()})
        given_some = columns[names[0]].isNotNull()
        return F.when(given_some & made.isNull(), F.raise_error(F.lit(f"no such form: {generator}"))).otherwise(made) if strict else made

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            first = row[names[0]] if row else None
            if first is None:
                out.append(None)
                continue
            try:
                out.append(func(**{k: v for k, v in row.items() if v is not None}, **constant))
            except (ValueError, TypeError, IndexError):
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(F.struct(*(c.alias(k) for k, c in columns.items())))


_AXIS_VALUES: Mapping[str, tuple] = {
    "tense": g.TENSES, "person": (*g.PERSONS, "1", "2", "3"), "aux": (*g.AUX, "ken"), "aspect": g.ASPECTS, "number": ("sg", "pl"), "possessive": g.PERSONS, "case": g.CASES,
    "copula": g.AUX, "kind": (*g.CONVERBS, *g.PARTICIPLES, "belirtili", "belirtisiz"),
}


def _check_axis(name: str, value) -> None:
    if value is not None and name in _AXIS_VALUES and value not in _AXIS_VALUES[name]:
        raise ValueError(f"unknown {name}: {value}")
    if name == "voice_chain" and any(v not in g.VOICES for v in value or ()):
        raise ValueError(f"unknown voice in {value}")


def _cells(words: DataFrame, word: str, cells: list[tuple[str, str, dict]]) -> DataFrame:
    """``word, cell_key, form`` of each word and cell that has a form."""
    spark = words.sparkSession
    grid = spark.createDataFrame([(i, k) for i, (k, _, _) in enumerate(cells)], "cell int, cell_key string")

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            _, generator, axes = cells[r["cell"]]
            try:
                out.append(getattr(g, generator)(r["word"], **axes) if r["word"] else None)
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    made = words.select(F.col(word).alias(word)).crossJoin(F.broadcast(grid)).withColumn("form", F.arrow_udf(run, "string")(F.struct(F.col(word).alias("word"), "cell")))
    return made.filter("form IS NOT NULL").select(word, "cell_key", "form")


def paradigm(verbs: DataFrame, lemma: str = "lemma") -> DataFrame:
    """The full table of each verb: tense, person and polarity."""
    return _cells(verbs, lemma, [(k, "conjugate", a) for k, a in g.paradigm_cells()])


def paradigm_noun(nouns: DataFrame, headword: str = "lemma") -> DataFrame:
    """The full table of each noun: case, number, possession and the layers above."""
    return _cells(nouns, headword, g.noun_cells())


def derivations(words: DataFrame, lemma: str = "lemma", pos: str = "pos") -> DataFrame:
    """``lemma, category, suffix, form, is_verb`` for each suffix that fits the word's part
    of speech; words of other parts of speech give no rows."""

    def run(rows: pa.Array) -> pa.Array:
        made = [g.derivations(r["w"], r["p"]) if r["w"] else None for r in rows.to_pylist()]
        return pa.array(made, pa.list_(pa.struct([("category", pa.string()), ("suffix", pa.string()), ("form", pa.string()), ("is_verb", pa.bool_())])))

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, "array<struct<category:string,suffix:string,form:string,is_verb:boolean>>")(F.struct(F.col(lemma).alias("w"), F.col(pos).alias("p")))
    return words.select(F.col(lemma).alias(lemma), F.inline(made))


def known_forms(lexicon: DataFrame) -> DataFrame:
    """``lemma, form`` of each verb, noun and adjective of ``lexicon`` (lemma, pos): what a
    list of corpus counts is joined with. Repeated forms of a lemma count once."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            found: set[str] = set()
            w, make = r["w"], []
            if w and r["p"] == "verb":
                make = [(g.conjugate, (w, t, p), {"negative": n, "ability": a}) for t in g.PERSONAL for p in g.PERSONS for n in (False, True) for a in (False, True)]
                make += [(g.converb, (w, k), {}) for k in g.CONVERBS]
                make += [(g.participle, (w, k), {"possessive": p, "case": c}) for k in g.PARTICIPLES for p in (None, *g.PERSONS) for c in (None, *g.CASES)]
            elif w and r["p"] in ("noun", "adj", "pron", "num", "adv"):
                make = [(g.decline, (w,), {"number": n, "possessive": p, "case": c}) for n in ("sg", "pl") for p in (None, *g.PERSONS) for c in g.CASES]
                make += [(g.copula, (w, x, p), {}) for x in (None, *g.AUX) for p in g.PERSONS]
            for f, args, axes in make:
                try:
                    found.add(f(*args, **axes))
                except (ValueError, IndexError):
                    continue
            out.append(sorted(x for x in found if x))
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, "array<string>")(F.struct(F.col("lemma").alias("w"), F.col("pos").alias("p")))
    return lexicon.select("lemma", F.explode(made).alias("form"))


def lemma_counts(lexicon: DataFrame, surface_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From corpus counts (surface, n): the sum per lemma over its forms, and the lemmas of
    the lexicon that no form of was seen."""
    hits = known_forms(lexicon).join(surface_counts.select(F.col("surface").alias("form"), "n"), "form").groupBy("lemma").agg(F.sum("n").alias("n"))
    return hits, lexicon.select("lemma").distinct().join(hits, "lemma", "left_anti")
