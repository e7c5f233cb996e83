"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is ``local``, as in tests, a temporary folder is
    made once for the session; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.tilsim.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilsim-")
        spark.conf.set("spark.tilsim.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tilsim/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps neither repeat
    its work nor depend on executors that may be lost."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text over all rows, in one aggregation."""
    got = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()
    return int(got["n"] or 0)


def pieces(total: int, each: int, least: int = 1) -> int:
    """Into how many pieces of about ``each`` to split ``total``."""
    return max(least, -(-int(total) // int(each)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
