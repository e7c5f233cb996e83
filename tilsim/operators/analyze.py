"""Morphological analysis of surfaces and texts as joins.

Distinct surfaces are analysed once. Each offers the lemmas that its readings could have;
a semi join with the lexicon leaves those that exist; only then are forms generated and
compared. The lexicon is never sent to Python workers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilsim.functions import analysis as a
from tilsim.functions.words import tokenize

_AXES = {
    "tense": "string", "person": "string", "negative": "boolean", "ability": "boolean", "question": "boolean", "aux": "string", "aspect": "string", "voice_chain": "array<string>",
    "number": "string", "possessive": "string", "case": "string", "converb_kind": "string", "base": "string", "ptype": "string", "suffix": "string", "src_pos": "string",
    "ki_case": "string", "ki_possessive": "string", "derivation": "string",
}
_SEGMENTS = "array<struct<surface:string,label:string,start:int,end:int>>"
_LEAF = f"struct<lemma:string,pos:string,kind:string,suffix:string,src_pos:string,segments:{_SEGMENTS},hypothetical:boolean>"
READING = (
    "struct<ord:int,lemma:string,pos:string,kind:string,axes:struct<" + ",".join(f"{k}:{t}" for k, t in _AXES.items()) + f">,axes_text:string,segments:{_SEGMENTS},hypothetical:boolean,chain:array<{_LEAF}>>"
)
#: Longer surfaces aren't analysed.
LONGEST = 200


def _as_dict(i: int, r: a.Reading) -> dict:
    axes = {"converb_kind" if k == "kind" else k: list(v) if isinstance(v, tuple) else v for k, v in r.axes.items()}
    leaf = lambda x: {"lemma": x.lemma, "pos": x.pos, "kind": x.kind, "suffix": x.axes.get("suffix"), "src_pos": x.axes.get("src_pos"), "segments": x.segments, "hypothetical": x.hypothetical}
    return {
        "ord": i, "lemma": r.lemma, "pos": r.pos, "kind": r.kind, "axes": {k: axes.get(k) for k in _AXES}, "axes_text": repr(sorted(r.axes.items())),
        "segments": r.segments, "hypothetical": r.hypothetical, "chain": [leaf(x) for x in r.chain],
    }


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def readings(surface: Column, roots: Column | None = None, pos: str | None = None, max_derivation_depth: int = 1) -> Column:
    """The readings of a surface; ``roots`` holds the lemmas that exist, null means all do.
    Null, blank and overlong surfaces have none."""
    if pos is not None and pos not in a.POS:
        raise ValueError(f"unknown part of speech: {pos}")
    kind = f"array<{READING}>"
    arrow = _arrow_type(kind)

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            s, known = r["s"], r.get("r")
            if not s or not s.strip() or len(s) > LONGEST:
                out.append([])
                continue
            found = a.analyze(s, pos, roots=None if known is None else frozenset(known), max_derivation_depth=max_derivation_depth)
            out.append([_as_dict(i, x) for i, x in enumerate(found)])
        return pa.array(out, arrow)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(F.struct(surface.alias("s"), *([roots.alias("r")] if roots is not None else [])))


def _offered(surface: Column, depth: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([a.lemma_candidates(t, depth) if t and len(t) <= LONGEST else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(surface)


def analyze(surfaces: DataFrame, roots: DataFrame | None = None, surface: str = "surface", pos: str | None = None, max_derivation_depth: int = 1) -> DataFrame:
    """``surface`` with its ``readings``, one row per distinct surface.

    ``roots`` (lemma) is the lexicon; without it every reading is kept as hypothetical.
    """
    distinct = surfaces.select(F.col(surface).alias("surface")).filter("surface IS NOT NULL").distinct()
    if roots is None:
        return distinct.withColumn("readings", readings(F.col("surface"), None, pos, max_derivation_depth))
    offered = distinct.select("surface", F.explode(_offered(F.col("surface"), max_derivation_depth)).alias("lemma"))
    known = offered.join(roots.select("lemma").distinct(), "lemma", "left_semi").groupBy("surface").agg(F.collect_set("lemma").alias("__roots"))
    none = F.array().cast("array<string>")
    return distinct.join(known, "surface", "left").select("surface", readings(F.col("surface"), F.coalesce("__roots", none), pos, max_derivation_depth).alias("readings"))


def reading_rows(analyzed: DataFrame) -> DataFrame:
    """One row per reading, its fields as columns; surfaces without readings give none."""
    return analyzed.select("*", F.inline("readings")).drop("readings")


def parse_text(texts: DataFrame, roots: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", max_derivation_depth: int = 1) -> DataFrame:
    """``<id_col>, idx, token, readings`` for each token of each text, in order by idx. An
    apostrophe that begins a token is left off before analysis. Tokens that recur anywhere
    are analysed once."""
    tokens = texts.select(F.col(id_col), F.posexplode(tokenize(F.col(text))).alias("idx", "token"))
    tokens = tokens.withColumn("surface", F.regexp_replace("token", "^'", ""))
    return tokens.join(analyze(tokens, roots, max_derivation_depth=max_derivation_depth), "surface", "left").select(id_col, "idx", "token", F.coalesce("readings", F.array().cast(f"array<{READING}>")).alias("readings"))


SCHEMA_VERSION = "1"


def reading_json(reading: Column) -> Column:
    """The versioned JSON record of a reading; default axes are left out."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), reading["lemma"].alias("lemma"), reading["pos"].alias("pos"), reading["kind"].alias("kind"), reading["axes"].alias("kwargs"), reading["segments"].alias("segments"), reading["hypothetical"].alias("hypothetical"), reading["chain"].alias("chain")))
