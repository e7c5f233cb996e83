"""Readers of lexicons, frequencies, models and tagged corpora; writers of their tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilsim.functions.words import tr_lower
from tilsim.operators.hmm import parse_tag

PARTS_OF_SPEECH = ("adj", "adv", "conj", "det", "dup", "interj", "noun", "num", "postp", "pron", "ques", "verb")
INFLECTED = ("adj", "adv", "noun", "num", "pron", "verb")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``lemma, pos`` of a two-column TSV; blank and partial lines are left out."""
    lines = spark.read.csv(path, sep="\t", schema="lemma string, pos string", quote="")
    return lines.select(F.trim("lemma").alias("lemma"), F.trim("pos").alias("pos")).filter("lemma != '' AND pos != ''")


def roots(lexicon: DataFrame, pos: str | Iterable[str] | None = None) -> DataFrame:
    """The distinct lemmas of some parts of speech, by default of those that inflect."""
    wanted = list(INFLECTED) if pos is None else [pos] if isinstance(pos, str) else list(pos)
    if unknown := sorted(set(wanted) - set(PARTS_OF_SPEECH)):
        raise ValueError(f"unknown parts of speech: {unknown}")
    return lexicon.filter(F.col("pos").isin(*wanted)).select("lemma").distinct()


def pos_map(lexicon: DataFrame, order: str | None = None) -> DataFrame:
    """One part of speech per lemma: the last by ``order`` if given, else the greatest."""
    return lexicon.groupBy("lemma").agg((F.max_by("pos", order) if order else F.max("pos")).alias("pos"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="lemma string, n bigint", quote="", comment="#").dropna()


def read_surface_counts(spark: SparkSession, path: str) -> DataFrame:
    """``surface, n`` of lines with a word and a whole number between white space."""
    parts = F.split(F.trim("value"), "\\s+")
    lines = spark.read.text(path).select(F.get(parts, 0).alias("surface"), F.get(parts, 1).try_cast("bigint").alias("n"), F.size(parts).alias("k"))
    return lines.filter("k = 2 AND n IS NOT NULL").select("surface", "n")


def read_log_probs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """A model table of three columns; # begins a comment. A missing file gives no rows."""
    schema = f"{first} string, {second} string, log_prob double"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, sep="\t", schema=schema, quote="", comment="#").dropna()


_DICTIONARY_POS = {p.capitalize(): p for p in PARTS_OF_SPEECH}


def dictionary_entry(line: Column) -> Column:
    """lemma and pos of a dictionary line ``word [P:Tag; ...]``; null for comments, blank
    lines, punctuation and verbs that aren't infinitives. Untagged infinitives are verbs,
    other untagged words and unknown tags nouns."""
    lemma = tr_lower(F.trim(F.split_part(line, F.lit(" ["), F.lit(1))))
    tag = F.regexp_extract(line, "P:([A-Za-z]+)", 1)
    infinitive = lemma.rlike("m[ae]k$")
    table = F.create_map(*(F.lit(x) for pair in _DICTIONARY_POS.items() for x in pair))
    pos = F.when(tag == "", F.when(infinitive, "verb").otherwise("noun")).otherwise(F.coalesce(table[tag], F.lit("noun")))
    bad = (F.trim(line) == "") | F.ltrim(line).startswith("#") | (lemma == "") | (tag == "Punc") | ((tag == "Verb") & ~infinitive)
    return F.when(~bad, F.struct(lemma.alias("lemma"), pos.alias("pos")))


def build_lexicon(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of dictionaries; of a lemma's entries the first source's first line counts."""
    found = None
    for i, path in enumerate(paths):
        one = spark.read.text(path).select(F.lit(i).alias("src"), F.monotonically_increasing_id().alias("line"), dictionary_entry(F.col("value")).alias("e")).filter("e IS NOT NULL").select("src", "line", "e.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "lemma string, pos string")
    first = F.row_number().over(Window.partitionBy("lemma").orderBy("src", "line"))
    return found.withColumn("k", first).filter("k = 1").select("lemma", "pos")


def read_tagged(spark: SparkSession, path: str, encoding: str = "cp1254") -> DataFrame:
    """``file, sent_id, idx, surface, tag, lemma, major_pos`` of corpora whose sentences stand
    between <S> and </S>, one token a line: surface, then its tags, the right one first."""

    def decoded(bodies: pa.Array) -> pa.Array:
        return pa.array([b.decode(encoding, "replace") for b in bodies.to_pylist()], pa.string())

    decoded.__annotations__ = {"bodies": pa.Array, "return": pa.Array}
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.arrow_udf(decoded, "string")("content").alias("body"))
    blocks = files.select("file", F.posexplode(F.split("body", "(?m)^<S[ >][^\\n]*\\n|^<S>\\r?\\n")).alias("sent_id", "block")).filter("sent_id > 0")
    lines = F.filter(F.split(F.split_part("block", F.lit("</S>"), F.lit(1)), "\\r?\\n"), lambda x: ~x.startswith("<") & (F.size(F.split(x, "\t")) > 1))
    each = blocks.select("file", "sent_id", F.posexplode(lines).alias("idx", "line"))
    parts = F.split("line", "\t")
    each = each.select("file", "sent_id", "idx", F.trim(parts[0]).alias("surface"), F.trim(parts[1]).alias("tag"))
    parsed = parse_tag(F.col("tag"))
    return each.select("*", parsed["lemma"].alias("lemma"), parsed["major_pos"].alias("major_pos"))


def conllu(tokens: DataFrame, sent_id: str = "sent_id", text: str | None = "text") -> DataFrame:
    """``<sent_id>, conllu``: ten tab-parted columns per token (id, form, lemma, upos, xpos,
    feats, head, deprel, deps, misc; absent ones are _) under the sentence's comments."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in tokens.columns else F.lit("_") for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")]
    lines = tokens.groupBy(sent_id, *([text] if text and text in tokens.columns else [])).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("k"), F.concat_ws("\t", *cells).alias("line")))).alias("l"))
    head = [F.concat(F.lit("# sent_id = "), F.col(sent_id).cast("string"))] + ([F.concat(F.lit("# text = "), F.col(text))] if text and text in tokens.columns else [])
    return lines.select(sent_id, F.concat_ws("\n", *head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("conllu"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="")
