"""Ranking readings: alone, with confidence, and among their neighbours.

Rows of readings carry ``key`` columns that name a token, the fields of a reading, and the
token's place in its sentence where context is used. Every order is total, so that a rerun
ranks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilsim.functions import analysis as a
from tilsim.functions.grammar import POSTPOSITIONS
from tilsim.functions.words import tr_lower

_VERBAL, _NOMINAL = ("conjugate", "converb", "participle"), ("decline", "copula")
_VERBAL_IN_CONTEXT = (*_VERBAL, "converb_ken", "converb_casina")
_NOMINAL_POS = tuple("adj adv conj det dup interj noun num postp pron ques".split())
_PRIOR = {"decline": 2, "conjugate": 2, "copula": 1}


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def with_signals(rows: DataFrame, freq: DataFrame | None = None, pos: DataFrame | None = None) -> DataFrame:
    """Adds __freq (0 for unknown lemmas), __pos (null likewise) and __fits: whether the kind
    agrees with the lexicon's part of speech, 1, 0 or -1."""
    rows = rows.join(freq.groupBy("lemma").agg(F.max("n").cast("double").alias("__freq")), "lemma", "left") if freq is not None else rows.withColumn("__freq", F.lit(0.0))
    rows = rows.join(pos.groupBy("lemma").agg(F.max("pos").alias("__pos")), "lemma", "left") if pos is not None else rows.withColumn("__pos", F.lit(None).cast("string"))
    kind = F.col("kind")
    fits = F.when(F.col("__pos") == "verb", F.when(kind.isin(*_VERBAL), 1).otherwise(-1)).when(F.col("__pos").isin(*_NOMINAL_POS), F.when(kind.isin(*_NOMINAL), 1).otherwise(-1)).otherwise(0)
    return rows.withColumn("__freq", F.coalesce("__freq", F.lit(0.0))).withColumn("__fits", fits)


def _order(with_freq: bool = True) -> list[Column]:
    kinds = _table({k: i for i, k in enumerate(a.KINDS)})
    first = [F.col("__freq").desc()] if with_freq else []
    return [
        *first, F.col("__fits").desc(), F.coalesce(_table(_PRIOR)[F.col("kind")], F.lit(0)).desc(), F.size("segments").asc(), F.size("segments").asc(),
        (F.size(F.coalesce("axes.voice_chain", F.array().cast("array<string>"))) > 0).asc(), F.coalesce(kinds[F.col("kind")], F.lit(99)).asc(), F.col("lemma").asc(), F.col("axes_text").asc(), F.col("ord").asc(),
    ]


def rank(rows: DataFrame, key: list[str], freq: DataFrame | None = None, pos: DataFrame | None = None, prefer_inflected: bool = False) -> DataFrame:
    """Adds ``rank`` from 1 within ``key``.

    With ``prefer_inflected`` the frequency doesn't order readings, but a plain past,
    evidential, present or future verb takes the first place of a bare noun if its lemma is
    at least twice as frequent and at least 1,000.
    """
    rows = with_signals(rows, freq, pos)
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*_order(not prefer_inflected))))
    if prefer_inflected and freq is not None:
        axes_free = F.col("axes_text") == "[]"
        best = F.max(F.when((F.col("rank") == 1) & (F.col("kind") == "decline") & axes_free, F.struct(F.greatest(F.col("__freq") * 2.0, F.lit(1000.0)).alias("least"), F.size("segments").alias("parts")))).over(w)
        rival = (F.col("kind") == "conjugate") & F.col("axes.voice_chain").isNull() & F.col("axes.tense").isin("past", "evid", "pres", "fut") & (F.size("segments") > best["parts"]) & (F.col("__freq") >= best["least"])
        ranked = ranked.withColumn("__rival", F.coalesce(rival, F.lit(False)))
        ranked = ranked.withColumn("__won", F.col("__rival") & (F.row_number().over(w.orderBy(F.col("__rival").desc(), *_order(True))) == 1))
        ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.col("__won").desc(), "rank"))).drop("__rival", "__won")
    return ranked.drop("__freq", "__pos", "__fits")


def disambiguate(rows: DataFrame, key: list[str], freq: DataFrame | None = None, pos: DataFrame | None = None) -> DataFrame:
    """:func:`rank` with ``confidence``: the softmax of 100 ln(1 + frequency), ten times the
    fit, three times the kind's prior, less the number of parts."""
    scored = with_signals(rows, freq, pos)
    raw = 100.0 * F.log1p("__freq") + 10.0 * F.col("__fits") + 3.0 * F.coalesce(_table(_PRIOR)[F.col("kind")], F.lit(0)) - F.size("segments")
    w = Window.partitionBy(*key)
    scored = scored.withColumn("rank", F.row_number().over(w.orderBy(*_order()))).withColumn("__raw", raw)
    scored = scored.withColumn("__e", F.exp(F.col("__raw") - F.max("__raw").over(w)))
    return scored.withColumn("confidence", F.col("__e") / F.sum("__e").over(w)).drop("__freq", "__pos", "__fits", "__raw", "__e")


_COUNTS = tuple("altı altmış beş bin bir dokuz doksan dört elli iki kırk milyar milyon on otuz sekiz seksen üç yedi yetmiş yirmi yüz".split())
_QUANTIFIERS = tuple("az bazı binlerce birçok birkaç birtakım bütün çok hangi her hiçbir kimi nice onlarca tüm yüzlerce".split())
_SPEAKERS = {"ben": "1sg", "biz": "1pl", "o": "3sg", "onlar": "3pl", "sen": "2sg", "siz": "2pl"}
_OWNERS = {"benim": "1sg", "bizim": "1pl", "onların": "3pl 3sg", "onun": "3sg", "senin": "2sg", "sizin": "2pl"}
_OBJECTS = ("topu",)


def rank_in_context(tokens: DataFrame, rows: DataFrame, sentence: str = "sent_id", idx: str = "idx", token: str = "token", freq: DataFrame | None = None, pos: DataFrame | None = None) -> DataFrame:
    """Ranks readings by what six rules see around them, then as :func:`rank` does.

    ``tokens`` has a row per token, readings or not; ``rows`` the readings with the same
    sentence and idx. Adds ``evidence`` and ``rank``; no reading is added or lost. All
    rules are window functions over a sentence:

    1. after a numeral, quantifier or adjective: nominal +3, verbal -3
    2. before a postposition: nominal in a case it governs +4, in another -2
    3. before a question particle: not itself a question +2, else -2
    4. person of the nearest pronoun to the left: the same +3 (+1 for the third), else -1
    5. owner to the left: nominal with its possessive +3, another nominal or a verb -1
    6. a listed pronoun with a verb elsewhere and a nominal before: accusative +3, nominative -3
    """
    key = [sentence, idx]
    scored = with_signals(rows, freq, pos)
    top = scored.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*_order()))).filter("__r = 1")
    case = F.when(F.col("kind").isin(*_NOMINAL), F.coalesce("axes.case", F.lit("nom")))
    top = top.select(*key, F.col("kind").alias("__k"), F.col("__pos").alias("__p"), case.alias("__case"))
    low = tr_lower(F.col(token))
    t = tokens.select(*key, low.alias("__low")).join(top, key, "left")
    s = Window.partitionBy(sentence).orderBy(idx)
    before, all_ = s.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(sentence)
    qualifies = F.col("__low").rlike("^\\d") | F.col("__low").isin(*_COUNTS, *_QUANTIFIERS) | (F.col("__k").isin(*_NOMINAL) & F.col("__p").isin("adj", "num"))
    owner = F.coalesce(_table(_OWNERS)[F.col("__low")], F.when(F.col("__case") == "gen", "3sg 3pl"))
    verbal = F.coalesce(F.col("__k").isin(*_VERBAL_IN_CONTEXT), F.lit(False)).cast("int")
    t = t.select(
        *key, "__low",
        F.coalesce(F.lag(F.coalesce(qualifies, F.lit(False))).over(s), F.lit(False)).alias("__qualified"),
        F.lead("__low").over(s).alias("__next"),
        F.last(_table(_SPEAKERS)[F.col("__low")], ignorenulls=True).over(before).alias("__speaker"),
        F.last(owner, ignorenulls=True).over(before).alias("__owner"),
        ((F.sum(verbal).over(all_) - verbal) > 0).alias("__verb"),
        (F.coalesce(F.sum((F.col("__k").isNotNull() & (verbal == 0)).cast("int")).over(before), F.lit(0)) > 0).alias("__nominal_before"),
    )
    x = scored.join(t, key)
    kind, mine = F.col("kind"), F.when(F.col("kind").isin(*_NOMINAL), F.coalesce("axes.case", F.lit("nom")))
    nominal, verbal = kind.isin(*_NOMINAL), kind.isin(*_VERBAL_IN_CONTEXT)
    governs = _table({w: c for w, (_, c) in POSTPOSITIONS.items()})[F.col("__next")]
    inside = lambda wanted, value: F.array_contains(F.split(wanted, " "), value)
    rules = [
        F.when(F.col("__qualified"), F.when(nominal, 3).when(verbal, -3)),
        F.when(governs.isNotNull() & nominal, F.when(inside(governs, mine), 4).otherwise(-2)),
        F.when(F.col("__next").isin("mı", "mi", "mu", "mü") & kind.isin("conjugate", "copula"), F.when(F.coalesce("axes.question", F.lit(False)), -2).otherwise(2)),
        F.when(F.col("__speaker").isNotNull() & kind.isin("conjugate", "copula") & F.col("axes.person").isNotNull(), F.when(F.col("axes.person") == F.col("__speaker"), F.when(F.col("__speaker") == "3sg", 1).otherwise(3)).otherwise(-1)),
        F.when(F.col("__owner").isNotNull(), F.when(nominal, F.when(F.coalesce(inside(F.col("__owner"), F.col("axes.possessive")), F.lit(False)), 3).otherwise(-1)).when(verbal, -1)),
        F.when(F.col("__low").isin(*_OBJECTS) & F.col("__verb") & F.col("__nominal_before"), F.when(mine == "acc", 3).when(mine == "nom", -3)),
    ]
    evidence = sum((F.coalesce(r, F.lit(0)) for r in rules), F.lit(0))
    x = x.withColumn("evidence", evidence)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("evidence").desc(), *_order())))
    return x.drop("__low", "__qualified", "__next", "__speaker", "__owner", "__verb", "__nominal_before", "__freq", "__pos", "__fits")
