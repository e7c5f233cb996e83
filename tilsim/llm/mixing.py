"""Mixing sources to target weights.

Tokens are summed per source; the target weight over the share a source holds gives its
repetition rate. Each document is emitted floor(rate) times, and once more if a hash of
the seed and its id falls below the fraction: a Bernoulli draw that any retry repeats.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilsim.llm.common import free_names, materialize

SEED = "mix-1"
#: Without explicit weights the target weight of a source is its tokens to this power.
TEMPER = 0.7
#: Rates of at most so many sources are broadcast: about 20 MB.
MOST_SENT = 200_000
SALTS = 32


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float = 1.0, source_col: str = "source", text_col: str = "text", temper: float = TEMPER) -> DataFrame:
    """One row per source: ``source``, ``source_tokens``, ``rate``.

    ``rate`` = target share x budget x all tokens / tokens of the source, at six decimals.
    With ``weights``, a source that they don't name has weight 0; without, a weight is
    tokens ** temper. A null source is a source of its own. A source without tokens has
    rate 1: repeating its empty documents would change no share.
    """
    per = docs.select(F.col(source_col).cast("string").alias("source"), n_tokens(F.col(text_col).cast("string")).alias("__n")).groupBy("source").agg(F.sum("__n").alias("source_tokens"))
    if weights is None:
        w = F.pow(F.col("source_tokens").cast("double"), F.lit(temper))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    per = per.withColumn("__w", F.when(F.col("source_tokens") > 0, w).otherwise(0.0))
    total = per.agg(F.sum("source_tokens").alias("__t"), F.sum("__w").alias("__s"))
    rate = F.when(F.col("source_tokens") == 0, 1.0).when(F.col("__s") > 0, F.col("__w") / F.col("__s") * F.lit(float(budget)) * F.col("__t") / F.col("source_tokens")).otherwise(0.0)
    return per.crossJoin(total).select("source", "source_tokens", F.round(rate, 6).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", temper: float = TEMPER, details: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """The columns of ``docs``, each row as often as its source's rate says.

    With ``details``: also ``copy_no`` from 1, ``rate`` and ``n_tokens``; a column of
    ``docs`` with such a name gives way. A row with a null id draws as the empty id does;
    repeated rows draw alike; an empty table gives an empty one. The only shuffle carries
    one partial sum per source and task. Up to MOST_SENT sources their rates are broadcast,
    so that no text moves; beyond it each rate stands in SALTS copies, over which the
    documents of a large source spread.
    """
    src, rate, own, salt, n, copy = free_names(docs.columns, "__source", "__rate", "__own", "__salt", "__copies", "__copy")
    per = materialize(rates(docs, weights, budget, source_col, text_col, temper), "mix-rates").select(F.col("source").alias(src), F.col("rate").alias(rate))
    fraction = F.col(rate) - F.floor(rate)
    copies = (F.floor(rate) + (draw(F.col(id_col), seed) < fraction).cast("int")).cast("int")
    same = F.col(source_col).cast("string").eqNullSafe(F.col(src))
    if per.count() <= most_sent:
        joined = docs.join(F.broadcast(per), same)
    else:
        per = per.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(own, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS)).cast("int")).join(per, same & (F.col(own) == F.col(salt)))
    joined = joined.withColumn(n, copies).filter(F.col(n) > 0)
    out = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    keep = [F.col(f"`{c}`") for c in docs.columns if not (details and c in ("copy_no", "rate", "n_tokens"))]
    more = [F.col(copy).alias("copy_no"), F.col(rate).alias("rate"), n_tokens(F.col(text_col).cast("string")).alias("n_tokens")] if details else []
    return out.select(*keep, *more)


MIX_RATES_SQL = f"""per AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT AS source_tokens FROM {{docs}} GROUP BY source),
    w AS (SELECT *, CASE WHEN source_tokens > 0 THEN pow(source_tokens::DOUBLE, {TEMPER}) ELSE 0.0 END AS w FROM per),
    r AS (SELECT source, CASE WHEN source_tokens = 0 THEN 1.0 ELSE round(w / (SELECT sum(w) FROM w) * (SELECT sum(source_tokens) FROM w) / source_tokens, 6) END AS rate FROM w)"""

MIX_SQL = f"""WITH {MIX_RATES_SQL.format(docs='documents')},
    d AS (SELECT documents.*, rate, floor(rate)::INT + (('0x' || substr(md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT / {float(1 << 52)} < rate - floor(rate))::INT AS copies
          FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy_no, rate, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM d WHERE copies > 0"""
