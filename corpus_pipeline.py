"""Training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; repeated runs of lines are deleted, and documents of which nothing is left go; one document of each near-duplicate group
stays; documents that hold a benchmark item go; the rest is encoded. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.llm.bpe_automaton import bpe_encode
from granulite.llm.common import read_table, small_batches, stored
from granulite.llm.decontaminate import decontaminate
from granulite.llm.line_dedup import line_dedup
from granulite.llm.minhash_dedup import minhash_dedup
from granulite.llm.toxicity import drop_toxic, train

#: Percent of shared shingles from which documents are near duplicates.
SIMILAR = 80
#: The toxicity stage and the encoder are not expressible in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled rows does not call toxic."""
    small_batches(spark)
    return drop_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in earlier ones; those left without any word go, others are never dropped."""
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    d = line_dedup(docs.withColumnsRenamed(own))
    d = d.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return d.drop(*own).withColumnsRenamed({o: c for c, o in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat an id with equal text one stays."""
    small_batches(spark)
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    row = F.xxhash64("doc_id", "text")
    groups = minhash_dedup(docs.select(row.alias("row"), "text"), id_col="row", percent=SIMILAR).select("row", F.col("component_id").alias("grp"))
    groups = stored(groups.join(docs.select(row.alias("row"), "doc_id"), "row"))
    stays = groups.groupBy("grp").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    drop = stored(groups.join(stays, "grp").where(F.col("row") != F.col("first.row")).select(F.col("row").alias("gone")))
    return docs.join(drop, row == F.col("gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("BPE encoding and decoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
