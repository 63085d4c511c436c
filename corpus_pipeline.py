"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents, extra ones too.
Once a stage's output is written, its input (but for the first) and what its operator wrote meanwhile are deleted.

Defined results: a null or empty text fails the base rule of the first stage and goes; a null language is
a language; a null doc_id counts as larger than all others in line dedup and stays in near-dedup; repeated
rows are judged alike, and of rows of one doc_id and one text none is another's copy; of near copies the
smallest doc_id stays; texts of any length are read whole; an empty table, or one of which a stage keeps
nothing, gives an empty result; columns of the operators' own names don't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.decontam import remove_contaminated
from docweave.llm.linededup import dedup_lines
from docweave.llm.neardup import drop_near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.quality import filter_quality
from docweave.runtime import remove_path, scratch, shared_path

#: Documents whose shingle sets are alike at this or more are near copies; op8's query has its own 85.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Sketches, tokenization and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            remove_path(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
