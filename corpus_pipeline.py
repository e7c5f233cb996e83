"""A corpus pipeline: five stages over documents, each one of the dealt operators.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilsim.llm import bpe, mixing, pii, simhash, toxicity
from tilsim.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon rejects go; the others stay as they are.

    Null and empty texts aren't toxic and stay; repeated rows go or stay together; rows with
    a null id stay by their text; further columns stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least id, of repeated ids
    one row, a row without an id only if the group has no other.

    Texts without words, null and empty ones too, are duplicates only of the same
    characters; further columns stay.
    """
    return simhash.drop_near_duplicates(docs)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text become pseudonyms of the same format.

    Equal values get equal pseudonyms, in repeated rows as well; null and empty texts stay.
    ``n_chars``, where there is such a column, counts the new text: null for a null one.
    """
    out = pii.replace_text(docs, key=pii.session_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or thin out so that their sources meet the target weights.

    A null source is one of its own; null and empty texts weigh nothing, but go with their
    source; repeated rows and equal ids draw alike; further columns stay.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, checked by decoding them.

    A null text has null ids, an empty one none; repeated rows and null ids stay.
    """
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymize),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Aho-Corasick over folded text, sketches, Feistel networks and BPE are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
