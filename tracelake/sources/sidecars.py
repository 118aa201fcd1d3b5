"""Small inputs beside recordings: metrics sidecars, session reports, artifact choice, evidence inventories, caches."""

from __future__ import annotations

import hashlib
import re
from decimal import ROUND_DOWN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
MAX_SIDECAR, MAX_FIELDS = 65_536, 21
#: The fields of a sidecar.
INTEGERS = (
    "instructions", "elapsed_ms", "encoded_bytes", "compressed_bytes", "cache_hits", "cache_misses", "cache_collisions", "buffer_swaps",
    "producer_waits", "producer_wait_ns", "effective_buffer_bytes",
)
RATES = {
    "instructions_per_second": ("instructions", 1000, "elapsed_ms"),
    "encoded_bytes_per_second": ("encoded_bytes", 1000, "elapsed_ms"),
    "disk_bytes_per_second": ("compressed_bytes", 1000, "elapsed_ms"),
    "compression_ratio": ("compressed_bytes", 1, "encoded_bytes"),
}
#: Version 1 counts the text's bytes.
RAW = {"encoded_bytes": "raw_bytes", "encoded_bytes_per_second": "raw_bytes_per_second"}
SUFFIXES = {".flight.bin": "ring", ".trace.bin.lz4": "stream", ".trace.bin": "stream", ".trace.txt.lz4": "text"}


def cut_ratio(numerator: int, denominator: int) -> Decimal:
    if not denominator:
        return Decimal("0.000000")
    return (Decimal(numerator * 10**6 // denominator) / 10**6).quantize(Decimal("0.000001"), ROUND_DOWN)


def parse_metrics(text: str, artifact: str | None = None) -> dict[str, int | str | Decimal]:
    """The values of a sidecar of version 1 (without a version's line), 2 or 3; every rate is recomputed and must agree to the digit.

    ValueError names the first fault: form, unknown, missing or repeated keys, ranges, rates.
    """
    if not text.isascii() or len(text) > MAX_SIDECAR:
        raise ValueError("sidecar is not ASCII or too large")
    lines = text.splitlines()
    if len(lines) > MAX_FIELDS:
        raise ValueError("sidecar has too many fields")
    found: dict[str, str] = {}
    for line in lines:
        key, sign, value = line.partition("=")
        if not (key and sign and value):
            raise ValueError("malformed sidecar line")
        if key in found:
            raise ValueError(f"repeated sidecar key {key}")
        found[key] = value
    version = found.get("metrics_version", "1")
    if version not in ("2", "3") and "metrics_version" in found:
        raise ValueError("unsupported metrics version")
    own = (lambda k: RAW.get(k, k)) if version == "1" else (lambda k: k)
    counters = [own(k) for k in INTEGERS]
    wanted = {"profile", "return", "cache_hit_rate", *counters, *map(own, RATES)}
    wanted |= {"1": set(), "2": {"metrics_version"}, "3": {"metrics_version", "termination", "return_valid"}}[version]
    if odd := sorted(found.keys() ^ wanted):
        raise ValueError(f"{'unknown' if odd[0] in found else 'missing'} sidecar key {odd[0]}")
    if artifact is not None and not artifact.endswith((".trace.txt.lz4",) if version == "1" else (".trace.bin", ".trace.bin.lz4")):
        raise ValueError("sidecar version does not fit the artifact")
    if found["profile"] not in ("fast", "balanced", "full") or not re.fullmatch(r"0x(?:0|[1-9a-f][0-9a-f]*)" if version == "3" else r"0x[0-9a-fA-F]+", found["return"]) or int(found["return"], 16) >= 2**64:
        raise ValueError("invalid profile or return")
    out: dict[str, int | str | Decimal] = {"metrics_version": int(version), "profile": found["profile"], "return": found["return"].lower()}
    for k in counters:
        if not re.fullmatch(r"[0-9]+", found[k]) or int(found[k]) >= 2**64:
            raise ValueError(f"invalid counter {k}")
        out[k] = int(found[k])
    rates = {own(k): cut_ratio(int(found[own(n)]) * by, int(found[own(d)])) for k, (n, by, d) in RATES.items()}
    rates["cache_hit_rate"] = cut_ratio(int(found["cache_hits"]), int(found["cache_hits"]) + int(found["cache_misses"]))
    for k, v in rates.items():
        if not re.fullmatch(r"[0-9]+\.[0-9]{6}", found[k]) or Decimal(found[k]) != v:
            raise ValueError(f"inconsistent rate {k}")
        out[k] = v
    if version == "3":
        stopped = found["termination"] == "stopped"
        if found["termination"] not in ("completed", "stopped") or found["return_valid"] != ("0" if stopped else "1") or (stopped and found["return"] != "0x0"):
            raise ValueError("inconsistent termination")
        out |= {"termination": found["termination"], "return_valid": int(found["return_valid"])}
    return out


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of every sidecar under a path; form errors are raised by ``parse_metrics`` on the driver side."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.select("path", F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("value"))


def terminal_agrees(terminals: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(artifact, agrees): whether a stream's terminal and its sidecar (wide, by artifact) have the same counters."""
    joined = terminals.join(sidecars, "artifact", "left")
    same = F.lit(True)
    for k in INTEGERS:
        same = same & F.col(f"terminal.{k}").eqNullSafe(F.col(k))
    return joined.select("artifact", F.coalesce(same, F.lit(False)).alias("agrees"))


REPORT = "session string, artifacts array<struct<name:string,path:string,format:string,sha256:string>>"


def open_session(spark: SparkSession, path: str) -> DataFrame:
    """(session, name, path, format, sha256, usable, warning) of the artifacts that report files list.

    A bad entry is a row with a warning, so that one broken artifact doesn't hide the others.
    """
    report = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = report.select("session", F.explode_outer("artifacts").alias("a")).select("session", "a.*")
    warning = (
        F.when(F.col("name").isNull(), "entry without a name")
        .when(F.col("path").isNull(), "entry without a path")
        .when(~F.coalesce(F.col("format"), F.lit("")).isin(*sorted(set(SUFFIXES.values()))), "unknown format")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid digest")
    )
    return rows.withColumn("warning", warning).withColumn("usable", F.col("warning").isNull())


def classify(files: DataFrame) -> DataFrame:
    """``files`` (name, modified) with ``format`` by suffix; other files have none."""
    kind = F.lit(None).cast("string")
    for suffix, what in SUFFIXES.items():
        kind = F.coalesce(kind, F.when(F.col("name").endswith(suffix), what))
    return files.withColumn("format", kind)


def choose(files: DataFrame, name: str | None = None, newest: bool = True) -> DataFrame:
    """The artifact of a name, else the newest supported one (ties: the greater name), else all."""
    known = classify(files).where("format IS NOT NULL")
    if name is not None:
        return known.where(F.col("name") == name)
    if not newest:
        return known
    return known.agg(F.max(F.struct("modified", "name", "format")).alias("x")).where("x IS NOT NULL").select("x.name", "x.modified", "x.format")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(directory, files, bytes, digest): what each directory holds; the digest is of its files' names and contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "sha"))), lambda x: F.concat_ws(":", x["name"], x["sha"])), "\n")
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(listed, 256).alias("digest"))


def source_digest(data: bytes, options: str = "") -> str:
    return hashlib.sha256(f"{SCHEMA_VERSION}|{options}|".encode() + hashlib.sha256(data).digest()).hexdigest()


def open_or_build(spark: SparkSession, cache: str, digest: str, build, partition_by: str = "artifact") -> DataFrame:  # noqa: ANN001
    """The cached table of a digest, or what ``build()`` gives, written there for the next time.

    The write's commit leaves a marker; a table without one is a cut-off write and is built again.
    """
    target = f"{cache.rstrip('/')}/{digest}"
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
        build().write.mode("overwrite").partitionBy(partition_by).parquet(target)  # _SUCCESS comes with the commit
    return spark.read.parquet(target)
