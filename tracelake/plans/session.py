"""Session helpers: a tuned builder, and the package for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(name: str = "tracelake", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and bounded Arrow batches; ``conf`` (a__b for a.b) wins."""
    usual = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (usual | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's checkpoint folder.  Only where none is set and the
    session is a local one (tests) a temporary folder takes its place.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
    return context._jsc.sc().getCheckpointDir().get()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows when the driver's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run, and one numeric thread each; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # tasks already use every core
        context.environment.setdefault(name, "1")
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tracelake-"), "tracelake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tracelake") / p.relative_to(root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
