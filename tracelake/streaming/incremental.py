"""Incremental work: scans that publish partial pages, scene pairing across chunks, progress and cancellation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tracelake.plans.session import ship
from tracelake.schema import KEY

MAX_OPEN = 4096


def stream_events(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 16, pattern: str = "*") -> DataFrame:
    """Committed files of a folder (of names that match) as a stream; files without a commit are never seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)


def partial_scan(rows: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the rows that pass a filter as they are found; pages over ``out`` are inexact until the query ends.

    The target is a file sink, so a batch that is run again isn't published twice.
    """
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query: StreamingQuery) -> dict[str, Any]:
    """Batches and rows so far, whether totals are exact yet, and the state: running, complete, failed or cancelled."""
    done = [p for p in query.recentProgress]
    failed = query.exception() is not None
    active = query.isActive
    return {
        "batches": len(done),
        "rows": sum(p["numInputRows"] for p in done),
        "exact_total": not active and not failed,
        "state": "failed" if failed else "running" if active else "complete",
    }


def partial_page(spark: SparkSession, out: str, limit: int, query: StreamingQuery | None = None) -> tuple[list, dict | None, bool]:
    """(rows, watermark key, exact): the first rows found so far.  The watermark is the greatest key seen."""
    found = spark.read.parquet(out)
    rows = found.orderBy(*KEY).limit(limit).collect()
    last = found.agg(F.max(F.struct(*KEY)).alias("k")).first()["k"]
    return rows, last.asDict() if last else None, query is None or progress(query)["exact_total"]


SCENES = "tid bigint, id bigint, entry bigint, ending bigint, state string"


class ScenePairs(StatefulProcessor):
    """Pairs enters with ends of the same id within a thread, across batches; bounded open enters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getMapState("open", "id bigint", "entry bigint, address bigint")
        self._count = handle.getValueState("count", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        n = self._count.get()[0] if self._count.exists() else 0
        whole = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in whole.itertuples(index=False):
            number = (int(r.id),)
            if r.phase == "enter":
                if self._open.containsKey(number):
                    raise ValueError(f"duplicate enter of thread {key[0]}, scene {r.id}")
                if n >= MAX_OPEN:
                    raise ValueError(f"over {MAX_OPEN} open scenes in thread {key[0]}")
                self._open.updateValue(number, (int(r.seq), int(r.address)))
                n += 1
            elif not self._open.containsKey(number):
                out.append((key[0], r.id, None, r.seq, "orphan"))
            else:
                entry, address = self._open.getValue(number)
                self._open.removeKey(number)
                n -= 1
                fits = address == r.address and entry < r.seq
                out.append((key[0], r.id, entry, r.seq, ("returned" if r.phase == "return" else r.phase) if fits else "invalid"))
        self._count.update((n,))
        frame = pd.DataFrame(out, columns=["tid", "id", "entry", "ending", "state"])
        yield frame.astype({"tid": "Int64", "id": "Int64", "entry": "Int64", "ending": "Int64"})

    def close(self) -> None:
        pass


def pair_stream(boundaries: DataFrame) -> DataFrame:
    """Closed scenes of a stream (tid, id, seq, phase, address) as their ends arrive; needs the RocksDB state store."""
    ship(boundaries.sparkSession)
    return boundaries.groupBy("tid").transformWithStateInPandas(ScenePairs(), SCENES, "append", "none")


def pair_stream_by_join(boundaries: DataFrame, late: str = "10 minutes", within: str = "1 day") -> DataFrame:
    """Pairs as a stream-stream join on (tid, id) with watermarks on ``ts``, for ids that are used once.

    The join forgets enters after ``within``: later ends find none.  It neither reports orphans nor
    refuses second boundaries of an id; ``pair_stream`` does all of that.
    """
    enters = boundaries.where("phase = 'enter'").select("tid", "id", F.col("seq").alias("entry"), "address", F.col("ts").alias("entry_ts")).withWatermark("entry_ts", late)
    ends = boundaries.where("phase <> 'enter'").select(F.col("tid").alias("x_tid"), F.col("id").alias("x_id"), F.col("seq").alias("ending"), "phase", F.col("address").alias("x_address"), F.col("ts").alias("end_ts")).withWatermark("end_ts", late)
    meet = (F.col("tid") == F.col("x_tid")) & (F.col("id") == F.col("x_id")) & (F.col("end_ts") >= F.col("entry_ts")) & (F.col("end_ts") <= F.col("entry_ts") + F.expr(f"INTERVAL {within}"))
    fits = (F.col("address") == F.col("x_address")) & (F.col("entry") < F.col("ending"))
    state = F.when(~fits, "invalid").when(F.col("phase") == "return", "returned").otherwise(F.col("phase"))
    return enters.join(ends, meet).select("tid", "id", "entry", "ending", state.alias("state"))


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event counts by kind in tumbling or sliding windows of ``ts``; rows later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")


def run_job(spark: SparkSession, job: str, work: Callable[[], Any]) -> Any:
    """Run work under a job group that ``cancel_job`` can stop."""
    spark.sparkContext.setJobGroup(job, job, interruptOnCancel=True)
    try:
        return work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel_job(spark: SparkSession, job: str) -> None:
    spark.sparkContext.cancelJobGroup(job)
