"""A corpus pipeline: quality, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs; all but the last return
the columns of ``documents``.

Defined cases of all stages: rows are decided one by one, whether their doc_id is
null, shared or their own; a null text is kept as it is by all filters but the
quality classifier, which scores it as an empty one, and is packed as its end id
alone; empty tables give empty results; very long texts are taken whole; columns
other than those of ``documents`` are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, line_dedup, ngram_join, packing, quality
from corpusloom.llm.common import cut, drop_folder, ensure_checkpoint_dir, keyed, read_table, sized_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_key").alias("doc_id"), "text")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` whose key is no doc_id of ``dropped``."""
    return sized_join(rows, cut(dropped.select(F.col("doc_id").alias("_key"))), "_key", "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels of both classes it rejects all or none."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier row has; what is left empty by that goes (of repeated rows all but the first)."""
    out = line_dedup.line_dedup(docs).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, one row: that with the smallest id, rows without an id last."""
    rows = keyed(docs, "_key")
    return without(rows, ngram_join.ngram_join(by_key(rows)).filter("component_id <> doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an occurrence of a benchmark window, with or without an id."""
    rows = keyed(docs, "_key")
    return without(rows, decontamination.decontaminate(by_key(rows), read_table(spark, sf_dir, "benchmark")).filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training, alignment and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages meet in the shared checkpoint folder, where the last one's rows stay."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:  # the rows that this stage has read
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
