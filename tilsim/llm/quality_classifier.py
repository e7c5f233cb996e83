"""Quality classifier by hierarchical empirical Bayes.

Three levels of evidence are combined on the log-odds scale. The document's own: binned
measurements, whose log-likelihood ratios come from label counts per bin. Its path and
its host: the share of good documents there, where each level is shrunk towards the one
above it (path to host, host to the global prior) with a strength that the method of
moments estimates from the spread between hosts or paths. Labels count as they are; a
document without one counts with its own posterior under the global prior, so sites that
nobody labelled are learnt as well. Everything is grouped aggregation in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilsim.llm.quality_rules import measurements, measurements_sql

#: Feature, SQL over the measurements, bins per unit; a bin is floor(value x bins), cut at CUT.
FEATURES = (
    ("symbols", "n_symbols / n_chars", 40.0),
    ("upper", "n_upper / greatest(n_letters, 1)", 20.0),
    ("exclaim", "n_exclaim / greatest(n_words, 1)", 10.0),
    ("letters", "n_letters / n_chars", 20.0),
    ("lines", "(n_lines - n_distinct_lines) / n_lines", 10.0),
    ("pipes", "n_pipes / greatest(n_words, 1)", 10.0),
    ("distinct", "n_distinct_words / greatest(n_words, 1)", 10.0),
    ("length", "ln(n_chars) / 2", 2.0),
)
#: The last bin takes all above it.
CUT = 40
SMOOTH = 1.0
#: Each feature is damped by this factor, as the features overlap.
DAMP = 0.7
KEEP_FROM = 0.5
#: Documents that a prior counts as, at least and at most.
_LEAST, _MOST = 1.0, 1000.0


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _moments(groups: DataFrame, by: list[str], prior: str) -> DataFrame:
    """kappa per parent: with p the shares, n the sizes and m the parent's mean,
    kappa = m(1-m)/between - 1, where between = max(spread - sampling noise, tiny)."""
    w = groups.withColumn("__p", F.col("__good") / F.col("__n"))
    agg = w.groupBy(*by) if by else w
    got = agg.agg(
        (F.sum(F.col("__n") * (F.col("__p") - F.col(prior)) * (F.col("__p") - F.col(prior))) / F.sum("__n")).alias("__spread"),
        (F.sum(F.col(prior) * (1 - F.col(prior))) / F.sum("__n")).alias("__noise"),
        F.max(prior).alias("__m"),
    )
    between = F.greatest(F.col("__spread") - F.col("__noise"), F.lit(1e-9))
    return got.withColumn("__kappa", F.least(F.greatest(F.col("__m") * (1 - F.col("__m")) / between - 1, F.lit(_LEAST)), F.lit(_MOST))).select(*by, "__kappa")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, score, keep`` for each row of ``docs``.

    ``labels`` holds ids and a 0/1 label; of repeated ids the mean label rounds to 0 or 1
    (a tie to 1), null ids and labels are left out. A null text counts as empty, a null
    host or path as one of its own. Without any label every bin's ratio is 0 and the
    prior one half. Repeated rows of ``docs`` stay, further columns are left out. Only
    ids, bins and counts are shuffled, never a text.
    """
    m = measurements(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("__host"), F.coalesce(F.col(path_col).cast("string"), F.lit("\x00")).alias("__path"), *(c.alias(k) for k, c in m.items()))
    bins = [F.least(F.greatest(F.coalesce(F.floor(F.round(F.expr(f"CASE WHEN n_chars > 0 THEN {sql} ELSE 0 END").cast("double") * k, 6)), F.lit(0)), F.lit(0)), F.lit(CUT)).cast("int").alias(f"__b{i}") for i, (_, sql, k) in enumerate(FEATURES)]
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("__y")).dropna().groupBy("doc_id").agg(F.floor(F.avg("__y") + 0.5).cast("int").alias("__y"))
    from tilsim.llm.common import materialize

    rows = materialize(base.select("doc_id", "__host", "__path", *bins).join(lab, "doc_id", "left"), "quality-bins")

    # label counts per bin: at most features x (CUT + 1) rows, whatever the input
    long = rows.filter("__y IS NOT NULL").select("__y", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"__b{i}").alias("b")) for i in range(len(FEATURES))))).alias("__fb"))
    per_bin = long.groupBy("__fb.f", "__fb.b").agg(F.sum("__y").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    counts = {(r["f"], r["b"]): (r["good"], r["n"]) for r in per_bin.collect()}
    good, n = sum(g for (f, _), (g, _) in counts.items() if f == 0), sum(k for (f, _), (_, k) in counts.items() if f == 0)
    prior = (good + SMOOTH) / (n + 2 * SMOOTH)
    evidence = F.lit(0.0)
    from math import log

    for i in range(len(FEATURES)):
        values = [0.0] * (CUT + 1)
        for b in range(CUT + 1):
            g, k = counts.get((i, b), (0.0, 0.0))
            share = lambda x, total: (x + SMOOTH) / (total + SMOOTH * (CUT + 1))
            values[b] = DAMP * log(share(g, good) / share(k - g, n - good)) if k and n else 0.0
        evidence = evidence + F.element_at(F.array(*map(F.lit, values)), F.col(f"__b{i}") + 1)
    scored = rows.withColumn("evidence", F.round(evidence, 9))
    own = F.coalesce(F.col("__y").cast("double"), _sigmoid(F.col("evidence") + _logit(F.lit(prior))))

    paths = scored.groupBy("__host", "__path").agg(F.sum(own).alias("__good"), F.count(F.lit(1)).cast("double").alias("__n"))
    hosts = paths.groupBy("__host").agg(F.sum("__good").alias("__good"), F.sum("__n").alias("__n"))
    whole = hosts.agg(((F.sum("__good") + 1) / (F.sum("__n") + 2)).alias("__prior"))
    hosts = hosts.crossJoin(whole)
    hosts = hosts.crossJoin(_moments(hosts, [], "__prior")).withColumn("__hrate", (F.col("__good") + F.col("__kappa") * F.col("__prior")) / (F.col("__n") + F.col("__kappa")))
    paths = paths.join(hosts.select("__host", "__hrate", "__prior"), "__host")
    paths = paths.join(_moments(paths, ["__host"], "__hrate"), "__host").withColumn("__prate", (F.col("__good") + F.col("__kappa") * F.col("__hrate")) / (F.col("__n") + F.col("__kappa")))
    site = paths.select("__host", "__path", "__hrate", "__prate")
    out = scored.join(site, ["__host", "__path"])
    score = _sigmoid(F.col("evidence") + _logit(F.col("__prate")))
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("__hrate", 6).alias("host_rate"), F.round("__prate", 6).alias("path_rate"), F.round(score, 6).alias("score"), (F.round(score, 6) >= KEEP_FROM).alias("keep"))


def classify_sql() -> str:
    """DuckDB SQL for ``classify(documents, labels)``."""
    n = len(FEATURES)
    bins = ", ".join(f"least(greatest(coalesce(floor(round((CASE WHEN n_chars > 0 THEN {sql} ELSE 0 END)::DOUBLE * {k}, 6)), 0), 0), {CUT})::INT AS b{i}" for i, (_, sql, k) in enumerate(FEATURES))
    long = " UNION ALL ".join(f"SELECT {i} AS f, b{i} AS b, y FROM rows WHERE y IS NOT NULL" for i in range(n))
    joins = " ".join(f"LEFT JOIN llr r{i} ON r{i}.f = {i} AND r{i}.b = b{i}" for i in range(n))
    total = " + ".join(f"coalesce(r{i}.v, 0.0)" for i in range(n))
    kappa = lambda m: f"least(greatest({m} * (1 - {m}) / greatest(spread - noise, 1e-9) - 1, {_LEAST}), {_MOST})"
    moments = lambda prior: f"sum(n * (good / n - {prior}) * (good / n - {prior})) / sum(n) AS spread, sum({prior} * (1 - {prior})) / sum(n) AS noise, max({prior}) AS m"
    return f"""
    WITH {measurements_sql("documents", "coalesce(source, chr(0)) AS host, coalesce(lang, chr(0)) AS path")},
    lab AS (SELECT doc_id, floor(avg(quality::DOUBLE) + 0.5)::INT AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    rows AS (SELECT m.doc_id, host, path, y, {bins} FROM m LEFT JOIN lab ON m.doc_id = lab.doc_id),
    per AS (SELECT f, b, sum(y)::DOUBLE AS good, count(*)::DOUBLE AS n FROM ({long}) GROUP BY ALL),
    totals AS (SELECT coalesce(sum(good), 0.0) AS good, coalesce(sum(n), 0.0) AS n FROM per WHERE f = 0),
    smooth AS (SELECT good, n, good + {SMOOTH * (CUT + 1)} AS g, n - good + {SMOOTH * (CUT + 1)} AS h, (good + {SMOOTH}) / (n + {2 * SMOOTH}) AS prior FROM totals),
    llr AS (SELECT f, b, {DAMP} * ln(((per.good + {SMOOTH}) / g) / ((per.n - per.good + {SMOOTH}) / h)) AS v FROM per, smooth),
    scored AS (SELECT rows.*, round({total}, 9) AS evidence FROM rows {joins}),
    own AS (SELECT *, coalesce(y::DOUBLE, 1 / (1 + exp(-(evidence + ln(prior / (1 - prior)))))) AS p FROM scored, smooth),
    paths AS (SELECT host, path, sum(p) AS good, count(*)::DOUBLE AS n FROM own GROUP BY ALL),
    hosts AS (SELECT host, sum(good) AS good, sum(n) AS n FROM paths GROUP BY host),
    whole AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS prior FROM hosts),
    hk AS (SELECT {kappa('m')} AS kappa, m AS prior FROM (SELECT {moments('prior')} FROM hosts, whole)),
    hr AS (SELECT host, (good + kappa * prior) / (n + kappa) AS rate FROM hosts, hk),
    pk AS (SELECT host, {kappa('m')} AS kappa, m AS rate FROM (SELECT host, {moments('rate')} FROM paths JOIN hr USING (host) GROUP BY host)),
    pr AS (SELECT host, path, rate AS host_rate, (good + kappa * rate) / (n + kappa) AS path_rate FROM paths JOIN pk USING (host)),
    done AS (SELECT doc_id, evidence, host_rate, path_rate, round(1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))), 6) AS score FROM own JOIN pr USING (host, path))
    SELECT doc_id, round(evidence, 6) AS evidence, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate, score, score >= {KEEP_FROM} AS keep FROM done"""
