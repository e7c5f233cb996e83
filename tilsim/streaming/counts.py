"""The stateless functions run on streams as they are; here is what keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilsim.functions.words import tokenize, tr_lower


def token_counts(stream: DataFrame, ts: str = "ts", text: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, token, n`` per window of event time; rows later than ``late`` are dropped."""
    tokens = stream.withWatermark(ts, late).select(F.col(ts), F.explode(tokenize(tr_lower(F.col(text)))).alias("token"))
    return tokens.groupBy(F.window(ts, window), "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "token", "n")
