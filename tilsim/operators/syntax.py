"""Phrase trees and dependencies of sentences, as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilsim.functions import phrases
from tilsim.operators import analyze as an
from tilsim.operators import ranking

_NODES = "array<struct<node_id:int,parent_id:int,ord:int,tag:string,surface:string,governs:array<string>>>"
_TOKENS = "array<struct<id:int,form:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string,misc:string>>"


def parse(texts: DataFrame, roots: DataFrame, lexicon: DataFrame | None = None, id_col: str = "sent_id", text: str = "text") -> DataFrame:
    """``<id_col>, tree, nodes, tokens`` per sentence: the tree in brackets, its nodes and its
    dependencies as arrays of rows.

    Each token is read once, by joins; the best of its readings goes on. The order of the
    rules is part of their meaning, so they run over a whole sentence in one Arrow UDF.
    ``lexicon`` (lemma, pos) tells adjectives among words that decline as nouns. A text
    without tokens has no row.
    """
    tokens = an.parse_text(texts, roots, id_col, text)
    rows = an.reading_rows(tokens).filter(~F.col("hypothetical"))
    best = ranking.rank(rows, [id_col, "idx"]).filter("rank = 1").select(id_col, "idx", "lemma", "pos", "kind", "axes")
    if lexicon is not None:
        best = best.join(lexicon.groupBy("lemma").agg(F.max("pos").alias("lexicon_pos")), "lemma", "left")
    else:
        best = best.withColumn("lexicon_pos", F.lit(None).cast("string"))
    joined = tokens.select(id_col, "idx", "token").join(best, [id_col, "idx"], "left")
    lines = joined.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "token", "lemma", "pos", "kind", "lexicon_pos", "axes")), _by_idx).alias("line"))
    arrow = an._arrow_type(f"struct<tree:string,nodes:{_NODES},tokens:{_TOKENS}>")

    def run(given: pa.Array) -> pa.Array:
        out = []
        for line in given.to_pylist():
            leaves = []
            for t in line:
                reading = None
                if t["kind"] is not None:
                    reading = {"lemma": t["lemma"], "pos": t["pos"], "kind": t["kind"], "axes": {k: v for k, v in t["axes"].items() if v is not None}}
                leaves.append(phrases.leaf(t["token"], reading, t["lexicon_pos"]))
            tree = phrases.parse(leaves)
            out.append({"tree": tree.bracketed(), "nodes": phrases.flat(tree), "tokens": phrases.dependencies(tree)})
        return pa.array(out, arrow)

    run.__annotations__ = {"given": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, f"struct<tree:string,nodes:{_NODES},tokens:{_TOKENS}>")("line")
    return lines.select(id_col, made.alias("m")).select(id_col, "m.*")


def _by_idx(a, b):
    return F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)


def tree_rows(parsed: DataFrame, id_col: str = "sent_id") -> DataFrame:
    return parsed.select(id_col, F.inline("nodes"))


def dependency_rows(parsed: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """What :func:`tilsim.sources.tables.conllu` writes."""
    return parsed.select(id_col, F.inline("tokens"))


_ELEMENT = "struct<label:string,tokens:array<string>,head_id:int,aliases:array<string>>"
_SENTENCE = (
    f"struct<elements:array<{_ELEMENT}>,sentence_type:struct<yuklem_turu:string,yuklem_yeri:string,olumluluk:string,soru:boolean,kip:string,yapi:string,eksiltili:boolean>,"
    f"clauses:array<struct<role:string,elements:array<{_ELEMENT}>,predicate_id:int,connector:string>>>"
)


def analyze_sentences(texts: DataFrame, roots: DataFrame, lexicon: DataFrame | None = None, freq: DataFrame | None = None, id_col: str = "sent_id", text: str = "text") -> DataFrame:
    """``<id_col>, elements, sentence_type, clauses`` per sentence.

    Of each token's readings with known lemmas the best goes on, and the first finite verb
    beside it; with ``freq`` a frequent verb may take a bare noun's place. ``lexicon``
    (lemma, pos) tells adjectives, adverbs, numerals and determiners.
    """
    from tilsim.functions import sentences
    from tilsim.functions.words import tr_lower
    from tilsim.operators.entities import ORGANISATIONS, PERSONS, PLACES

    tokens = an.parse_text(texts, roots, id_col, text)
    rows = an.reading_rows(tokens).filter(~F.col("hypothetical"))
    fields = F.struct("lemma", "pos", "kind", "axes")
    ranked = ranking.rank(rows, [id_col, "idx"], freq, None, prefer_inflected=True)
    best = ranked.groupBy(id_col, "idx").agg(F.min_by(fields, "rank").alias("best"), F.min_by(F.when(F.col("kind") == "conjugate", fields), F.when(F.col("kind") == "conjugate", F.col("ord"))).alias("verb"))
    joined = tokens.select(id_col, "idx", F.col("token").alias("surface")).join(best, [id_col, "idx"], "left")
    if lexicon is not None:
        known = lexicon.groupBy("lemma").agg(F.max("pos").alias("p"))
        joined = joined.withColumn("__l", F.col("best.lemma")).withColumn("__s", tr_lower(F.col("surface")))
        joined = joined.join(known.select(F.col("lemma").alias("__l"), F.col("p").alias("__p1")), "__l", "left").join(known.select(F.col("lemma").alias("__s"), F.col("p").alias("__p2")), "__s", "left")
        joined = joined.withColumn("lexicon_pos", F.coalesce("__p1", "__p2"))
    else:
        joined = joined.withColumn("lexicon_pos", F.lit(None).cast("string"))
    lines = joined.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "surface", "best", "verb", "lexicon_pos")), _by_idx).alias("line"))
    arrow, names = an._arrow_type(_SENTENCE), frozenset((*PERSONS, *PLACES, *ORGANISATIONS))

    def bare(r: dict | None) -> dict | None:
        return r and {**r, "axes": {k: v for k, v in r["axes"].items() if v is not None}}

    def run(given: pa.Array) -> pa.Array:
        as_dict = lambda e: {"label": e.label, "tokens": list(e.tokens), "head_id": e.head_id, "aliases": list(e.aliases)}
        out = []
        for line in given.to_pylist():
            a = sentences.analyze([{**t, "best": bare(t["best"]), "verb": bare(t["verb"])} for t in line], names)
            out.append({"elements": [as_dict(e) for e in a["elements"]], "sentence_type": a["sentence_type"], "clauses": [{**c, "elements": [as_dict(e) for e in c["elements"]]} for c in a["clauses"]]})
        return pa.array(out, arrow)

    run.__annotations__ = {"given": pa.Array, "return": pa.Array}
    return lines.select(id_col, F.arrow_udf(run, _SENTENCE)("line").alias("m")).select(id_col, "m.*")
