"""Writing intermediate tables to the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and the master is local, as
    in tests, a temporary folder made once for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tilsim.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilsim-")
        spark.conf.set("spark.tilsim.shared.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: its work isn't repeated by the branches that
    follow, and a lost executor costs none of it."""
    path = f"{shared_dir(df.sparkSession)}/tilsim/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
