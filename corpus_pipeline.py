"""A corpus in five stages: language, near-duplicates, repeated strings, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as Parquet and
reads them again. Stages but the last return the columns of documents, whose n_chars follows a changed text. Part of the
subpackage peakpool.llm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm import bpe, decontaminate, jaccard, langid, substrings
from peakpool.llm.common import table, written

#: Near-duplicates are told by shingles of so many words, and by a Jaccard similarity of their sets of so much at least.
SHINGLE, LEAST = 5, (4, 5)


def with_text(r: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of docs from r's `carry`, with another text and its length where it has changed."""
    own = {"text": text, "n_chars": F.when(changed, F.char_length(text).cast("bigint")).otherwise(F.col("carry.n_chars"))}
    return r.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"carry.{c}").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, for which no language can be told, and names the language of those that have no label;
    learns from the labels of its own input. Without any label no language is named, and all texts with a letter stay."""
    told = langid.identify(docs, carry=docs.columns).where("lang_pred is null or lang_pred <> 'und'")
    named = {"lang": F.coalesce(F.col("carry.lang"), F.col("lang_pred").cast(docs.schema["lang"].dataType))}
    return told.select(*[named.get(c, F.col(f"carry.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id; of equal rows one."""
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    groups = jaccard.near_duplicates(docs.select(row.alias("row"), "text"), id_col="row", shingle=SHINGLE, least=LEAST)
    key = lambda c: F.concat(F.coalesce(F.col(f"{c}.doc_id").cast("string"), F.lit("")), F.lit(":"), F.col(f"{c}.hash").cast("string"))
    first = groups.where(F.col("row").eqNullSafe(F.col("component_id"))).select(key("row").alias("row_key"))
    own = docs.withColumn("row", row).withColumn("row_key", key("row")).drop("row")
    return own.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out all 100-byte strings that start earlier in the corpus. Of a character that is cut in two the rest goes as well;
    documents of which nothing is left go."""
    r = substrings.dedup_substrings(docs, keep="text", carry=[c for c in docs.columns if c != "text"])
    return with_text(r, docs, F.col("kept").cast("string"), F.col("n_removed") > 0).where("text <> ''")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents with passages of several items or mostly of passages."""
    r = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=[c for c in docs.columns if c != "text"])
    return with_text(r.where(~F.col("drop")), docs, F.col("cleaned_text"), F.col("n_hit") > 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each document."""
    return bpe.bpe_encode(docs, bpe.tokenizer_path(), digests=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("benchmark", benchmark), ("tokens", tokens)]

#: The automaton, the near-duplicates' links and the tokenizer have no like in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
