"""Shared helpers: tables, shared scratch tables, label selection, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.session import shared_dir, ship

ROWS_PER_SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, path: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    The table's path is appended to ``path`` so that a caller can drop it; else
    the table goes when the driver ends.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(target)
    delete_at_end(spark, target)
    if path is not None:
        path.append(target)
    return spark.read.schema(df.schema).parquet(target)


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_table(spark: SparkSession, path: str) -> None:
    fs, target = _place(spark, path)
    fs.delete(target, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a table of intermediate rows when the driver's JVM ends."""
    fs, target = _place(spark, path)
    fs.deleteOnExit(target)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out of all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows (doc_id, label) outside the held-out fold.

    Rows are chosen by a hash of the id, so the choice doesn't depend on
    partitioning.  Null ids, null labels and repeated ids are left out.
    """
    rows = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .where(fold(F.col("doc_id")) != 1)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = rows.count()
    if total > bound:
        share = int(bound / total * 1_000_000)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1_000_000)) < share)
    return rows


def labelled_texts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the ``chosen`` (doc_id, label) rows, one row for each id.

    Of an id's texts the one with the smallest hash stands for it, so repeated ids
    neither add rows nor weigh more; which one doesn't depend on partitioning.
    """
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen is bounded
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    return one.select("doc_id", "label", "x.text")


def bounded_slices(batch: pa.RecordBatch, texts: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (a column number) have about ``limit`` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(
    df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """Apply ``work`` to slices of columns, a bounded number of rows at a time."""
    ship(df.sparkSession)
    names = df.columns
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                made = work({n: piece.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, target)
