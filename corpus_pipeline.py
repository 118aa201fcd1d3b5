"""A training-data pipeline over ``documents``: classify, dedupe lines and texts, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import common, decontamination, line_dedup, quality_qda, simhash
from tracelake.llm.queries import packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; their columns are unchanged."""
    return quality_qda.keep_good(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines that an earlier document has; texts that lose every word go."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return simhash.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all texts, with a checksum of each piece's ids."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor patience diff nor packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{common.shared_dir(spark)}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            common.delete_at_end(spark, path)
            docs = spark.read.parquet(path)
    return docs
