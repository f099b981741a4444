"""A cleaning pipeline over `documents`: stages that each write Parquet for the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.llm import decontaminate, language, ngram_join, packing, secrets, textnum
from leadspark.llm.textnum import ensure_checkpoint_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject; models learn from the documents' own lang, held-out ids apart."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return language.without_rejected(docs, language.fit(docs.where(~held_out)))


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row, `__row`, that is the same whenever it is read: the row's place in its file.

    What is not a plain read of Parquet files is written to the shared folder first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "parquet" not in docs._jdf.queryExecution().analyzed().toString():
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    named = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = named.select("__file").distinct().withColumn("__n", F.row_number().over(Window.orderBy("__file")))  # one row a file
    return named.join(F.broadcast(files.checkpoint()), "__file").withColumn("__row", F.col("__n") * F.lit(1 << 40) + F.col("__at")).drop("__file", "__n", "__at")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of smallest doc_id, and of rows of one doc_id the smallest text.

    Groups hold rows, not ids: rows that repeat an id, or have none, are grouped by their texts alone.
    A null doc_id counts as the smallest, as in Spark's order.  Rows without words stay.
    """
    rows = numbered(spark, docs)
    groups = ngram_join.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id").checkpoint()
    several = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    members = groups.join(several, "component_id").join(rows.select("__row", "doc_id"), "__row").checkpoint()
    # texts are compared only where rows of a group share an id
    ties = members.groupBy("component_id", F.coalesce("doc_id", F.lit(0)).alias("i"), F.isnull("doc_id").alias("j")).agg(F.count("*").alias("n")).where("n > 1")
    tied = members.join(ties.select("component_id", F.when(~F.col("j"), F.col("i")).alias("t")), "component_id").where("doc_id <=> t").select("__row").checkpoint()
    if tied.limit(1).count():
        texts = rows.where(ngram_join.may_hold(tied)("__row")).select("__row", "text").join(tied, "__row")
        members = members.join(texts, "__row", "left")
    else:
        members = members.withColumn("text", F.lit(None).cast("string"))
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "text", "__row"))["__row"].alias("__row"))
    dropped = members.join(first, "__row", "left_anti").select("__row").checkpoint()
    textnum.release()
    # only rows that may be dropped are exchanged; the others' texts stay where they are
    some = ngram_join.may_hold(dropped)("__row")
    kept = rows.where(some).join(dropped, "__row", "left_anti").unionByName(rows.where(~some))
    return kept.select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`; null and empty texts stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live credentials give way to a mark, and n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in the packed sequences; see packing.pack()."""
    return packing.pack(docs, *packing.vocabulary())


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_live_secrets),
    ("packing", pack_sequences),
]

#: Language models, SimHash and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
