"""Metrics: truncated rates, exact medians and ranks, constancy, diagnosis, speedups, run oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import fixed_six
from tracelake.functions.u64 import u64_hex


def rates(rows: DataFrame) -> DataFrame:
    """``rows`` of counters with the five derived rates, cut to six digits."""
    per_second = lambda c: fixed_six(F.col(c).cast("decimal(38,0)") * 1000, F.col("elapsed_ms"))
    return rows.withColumns(
        {
            "instructions_per_second": per_second("instructions"),
            "encoded_bytes_per_second": per_second("encoded_bytes"),
            "disk_bytes_per_second": per_second("compressed_bytes"),
            "compression_ratio": fixed_six(F.col("compressed_bytes"), F.col("encoded_bytes")),
            "cache_hit_rate": fixed_six(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")),
        }
    )


def median(c: Column) -> Column:
    """The exact median: the mean of the middle two for an even number."""
    return F.median(c)


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value with at least ``share`` of the values at or below it."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def constant(column: str, what: str) -> Column:
    """The one value of a column over all runs; an error where runs disagree."""
    c = F.col(column)
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit(f"{what} differs between runs")))


def diagnose(rows: DataFrame) -> DataFrame:
    """``rows`` with wait and miss shares and the cost that dominates: the producer's wait if it takes over half of the time.

    Misses are an indicator only: they have no time to compare, so they never dominate.
    """
    wait = F.when(F.col("elapsed_ms") > 0, F.col("producer_wait_ns") / (F.col("elapsed_ms") * 1_000_000.0)).otherwise(0.0)
    looked = F.col("cache_hits") + F.col("cache_misses")
    miss = F.when(looked > 0, F.col("cache_misses") / looked).otherwise(0.0)
    half = F.col("producer_wait_ns").cast("decimal(38,0)") * 2 > F.col("elapsed_ms").cast("decimal(38,0)") * 1_000_000
    dominant = F.when(half & (F.col("elapsed_ms") > 0), "producer_wait_time").otherwise("undetermined")
    return rows.withColumn("wait_share", wait).withColumn("miss_share", miss).withColumn("dominant", dominant)


def speedups(current: DataFrame, baseline: DataFrame, on: Sequence[str], runs: int = 5, least: float = 1.0) -> DataFrame:
    """(on.., baseline_ms, current_ms, speedup, passed) of median times; fewer than ``runs`` runs never pass."""
    side = lambda d, n: d.groupBy(*on).agg(F.median("elapsed_ms").alias(n), F.count("*").alias(f"{n}_runs"))
    both = side(baseline, "baseline_ms").join(side(current, "current_ms"), list(on))
    ratio = F.when(F.col("current_ms") > 0, F.col("baseline_ms") / F.col("current_ms"))
    enough = (F.col("baseline_ms_runs") >= runs) & (F.col("current_ms_runs") >= runs)
    return both.withColumn("speedup", ratio).withColumn("passed", enough & F.coalesce(F.col("speedup") >= least, F.lit(False)))


def gate(results: DataFrame) -> DataFrame:
    """One row: whether all passed, whether any did, and the greatest and least speedup."""
    return results.agg(F.bool_and("passed").alias("all_passed"), F.bool_or("passed").alias("any_passed"), F.max("speedup").alias("best"), F.min("speedup").alias("worst"))


#: Runs that a profile's gate takes, and what every run must have in common with the baseline.
GATE_RUNS = 5
SAME = ("instructions", "return_value", "decoded_events", "first_instruction", "last_instruction")


def profile_gate(runs: DataFrame, baseline: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each profile: does the median rate reach its target, is no run larger than the baseline?

    ``runs`` and ``baseline`` (one row for each profile) have profile, ``SAME`` and compressed_bytes, runs also
    instructions_per_second; ``targets`` has profile and target_rate.  Another number of runs than
    ``GATE_RUNS``, or a run that differs from the baseline in ``SAME``, is an error.
    """
    base = baseline.select("profile", F.col("compressed_bytes").alias("baseline_bytes"), *[F.col(c).alias(f"base_{c}") for c in SAME])
    alike = F.lit(True)
    for c in SAME:
        alike = alike & F.lower(F.col(c).cast("string")).eqNullSafe(F.lower(F.col(f"base_{c}").cast("string")))
    rows = runs.join(base, "profile").groupBy("profile", "baseline_bytes").agg(
        F.count("*").alias("n"), F.bool_and(alike).alias("alike"), F.median("instructions_per_second").alias("rate"), F.max("compressed_bytes").alias("largest_bytes"),
        F.bool_and(F.col("compressed_bytes") <= F.col("baseline_bytes")).alias("meets_size_target"),
    )
    sound = F.when(F.col("n") != GATE_RUNS, F.raise_error(F.lit(f"a profile's gate takes {GATE_RUNS} runs"))).when(~F.col("alike"), F.raise_error(F.lit("a run differs from the baseline"))).otherwise(F.lit(True))
    return rows.join(targets, "profile").where(sound).select("profile", "target_rate", (F.col("rate") >= F.col("target_rate")).alias("meets_rate_target"), "baseline_bytes", "largest_bytes", "meets_size_target")


def run_oracle(instructions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, first, last): the number of instructions and the texts of the first and last."""
    text = F.concat_ws(" ", F.col("sequence").cast("string"), F.concat("module", F.lit("+"), u64_hex(F.col("relative_pc"))), "mnemonic")
    return instructions.withColumn("__text", text).groupBy(*by).agg(
        F.count("*").alias("n"), F.min_by("__text", "sequence").alias("first"), F.max_by("__text", "sequence").alias("last")
    )


def content_identity(schema_version: int, source_format: str, event_count: int, artifact_sha256: str) -> str:
    """The identity of a store's content: of its source, not of its rows."""
    return hashlib.sha256(f"{schema_version}|{source_format}|{event_count}|{artifact_sha256}".encode()).hexdigest()


def store_identity(content: str, layout: str) -> str:
    return hashlib.sha256(f"{content}|{layout}".encode()).hexdigest()
