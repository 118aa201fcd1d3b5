"""Ranges: islands, gaps, coalescing, completeness and its verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.intervals import bucket as bucket_of
from tracelake.operators.intervals import carry_rows
from tracelake.schema import CAUSES, PROVENANCES, rank_of

BUCKET_WIDTH, WIDE_BUCKET = 1 << 16, 1 << 40


def _top(runs: DataFrame, by: Sequence[str], step: Column) -> DataFrame:
    """Runs (by.., lo, hi, __step, __b) of buckets, joined over the buckets' edges.

    Only a run that touches its bucket's edge can go on in the next one; all others are
    final and take no part.  Edges are joined within wide buckets first and then once in
    all, where at most two runs of a wide bucket are left.
    """

    def fuse(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("lo", "hi")
        upto = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("__start", F.when(F.col("lo") <= upto + step, 0).otherwise(1))
        marked = marked.withColumn("__run", F.sum("__start").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("__step").alias("__step")).drop("__run")

    inner = runs.where(~F.col("__edge")).select(*by, "lo", "hi")
    wide = fuse(runs.where("__edge").withColumn("__b", bucket_of(F.col("lo"), WIDE_BUCKET)), [*by, "__b"])
    wide = _edges(wide, by, WIDE_BUCKET)
    last = fuse(wide.where("__edge").drop("__b"), by)
    return inner.unionByName(wide.where(~F.col("__edge")).select(*by, "lo", "hi")).unionByName(last.select(*by, "lo", "hi"))


def _edges(runs: DataFrame, by: Sequence[str], bucket: int) -> DataFrame:
    """``runs`` (by.., lo, hi, __b) with ``__edge``: whether one can touch or overlap a run of another bucket.

    It does at its bucket's first or last value or beyond, or where a run of an earlier bucket reaches it.
    """
    mask = F.lit(bucket - 1)
    far = runs.groupBy(*by, "__b").agg(F.max("hi").alias("__far"))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    met = runs.join(far.select(*by, "__b", F.max("__far").over(across).alias("__far")), [*by, "__b"], "left")
    own = (F.col("lo").bitwiseAND(mask) == 0) | (F.col("hi").bitwiseAND(mask) == mask) | (bucket_of(F.col("hi"), bucket) > F.col("__b"))
    return met.withColumn("__edge", own | F.coalesce(F.col("__far") >= F.col("lo") - 1, F.lit(False))).drop("__far")


def islands(rows: DataFrame, column: str, by: Sequence[str] = (), bucket: int = BUCKET_WIDTH) -> DataFrame:
    """(by.., lo, hi) inclusive runs of consecutive values.

    Values are joined to runs within buckets of ``bucket`` consecutive numbers, spread
    over tasks; beyond that only runs at a bucket's edge go on.
    """
    values = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("bigint").alias("__v")).distinct()
    values = values.withColumn("__b", bucket_of(F.col("__v"), bucket))
    inside = Window.partitionBy(*by, "__b").orderBy("__v")
    runs = values.withColumn("__g", F.col("__v") - F.row_number().over(inside)).groupBy(*by, "__b", "__g").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    return _top(_edges(runs.withColumn("__step", F.lit(1)), by, bucket), by, F.lit(1))


def missing(rows: DataFrame, column: str, by: Sequence[str] = (), start: int | None = None, end: int | None = None, bucket: int = BUCKET_WIDTH) -> DataFrame:
    """(by.., lo, hi) inclusive ranges in start..end without a value; nothing where ``start`` is 0.

    Without ``start`` or ``end`` the group's own least and greatest values stand in.  Gaps
    are read between runs: the next run's start is carried back within buckets, and from
    bucket to bucket only by one row each.
    """
    if start == 0:
        return islands(rows, column, by).limit(0)
    keys = list(by) or ["__all"]
    runs = islands(rows, column, by, bucket)
    runs = runs if by else runs.withColumn("__all", F.lit(0))
    later = carry_rows(runs, keys, "lo", {"next": F.col("lo")}, width=bucket, back=True, strict=True)
    parts = later.where("next IS NOT NULL").select(*by, (F.col("hi") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))
    edges = runs.groupBy(*by).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    if start is not None:
        parts = parts.union(edges.select(*by, F.lit(start).cast("bigint"), F.col("first") - 1))
    if end is not None:
        parts = parts.union(edges.select(*by, F.col("last") + 1, F.lit(end).cast("bigint")))
    low = F.col("lo") if start is None else F.greatest("lo", F.lit(start).cast("bigint"))
    high = F.col("hi") if end is None else F.least("hi", F.lit(end).cast("bigint"))
    return parts.select(*by, low.alias("lo"), high.alias("hi")).where("lo <= hi")


def declared_gaps(observed: DataFrame, declared: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by.., lo, hi, part): inner gaps, and head and tail up to the declared bounds (by.., first, last)."""
    inner = missing(observed, column, by).withColumn("part", F.lit("inner"))
    seen = observed.groupBy(*by).agg(F.min(column).cast("bigint").alias("seen_lo"), F.max(column).cast("bigint").alias("seen_hi"))
    edges = declared.groupBy(*by).agg(F.min("first").alias("d_lo"), F.max("last").alias("d_hi")).join(seen, list(by), "left")
    head = edges.select(*by, F.col("d_lo").alias("lo"), F.coalesce(F.col("seen_lo") - 1, F.col("d_hi")).alias("hi"), F.lit("head").alias("part"))
    tail = edges.where("seen_hi IS NOT NULL").select(*by, (F.col("seen_hi") + 1).alias("lo"), F.col("d_hi").alias("hi"), F.lit("tail").alias("part"))
    return inner.unionByName(head).unionByName(tail).where("lo <= hi")


def coalesce_ranges(ranges: DataFrame, by: Sequence[str], inclusive: Column | bool = True, bucket: int = BUCKET_WIDTH) -> DataFrame:
    """(by.., lo, hi) with overlapping and adjacent ranges joined; inclusive ones are adjacent at last + 1.

    ``inclusive`` is the same for all ranges of a group.  Ranges within a bucket come
    together on their own; beyond that only those that reach its edge go on.
    """
    step = F.when(F.lit(inclusive) if isinstance(inclusive, bool) else inclusive, 1).otherwise(0)
    base = ranges.select(*by, F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), step.alias("__step"), bucket_of(F.col("lo"), bucket).alias("__b"))
    order = Window.partitionBy(*by, "__b").orderBy("lo", "hi")
    upto = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = base.withColumn("__start", F.when(F.col("lo") <= upto + F.col("__step"), 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "__b", "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("__step").alias("__step"))
    return _top(_edges(runs, by, bucket), by, F.col("__step"))


def completeness_status(ranges: DataFrame, artifacts: DataFrame, by: Sequence[str], reports_damage: bool = True) -> DataFrame:
    """(by.., status) of ranges (by.., domain, lo, hi, cause) of ``artifacts`` (by.., format, first, last).

    Anything but retained makes a group incomplete.  Else it is complete where damage would be
    reported and the retained ranges have no hole: of a stream its source bytes from 0 on (their
    end isn't checked), of a ring the sequences ``first`` to ``last`` that were observed.  All else,
    also another format, is unknown.
    """
    bad = ranges.groupBy(*by).agg(F.max(F.when(F.col("cause") != "retained", 1).otherwise(0)).alias("bad"))
    held = ranges.where("cause = 'retained' AND (domain <> 'source_bytes' OR lo < hi)").withColumn("inc", F.col("domain") == "sequence")
    runs = coalesce_ranges(held, [*by, "domain"], inclusive=F.col("inc"))
    bytes_held = runs.where("domain = 'source_bytes'").groupBy(*by).agg((F.count("*") == 1).alias("one"), (F.min("lo") <= 0).alias("from_start"))
    spans = artifacts.where("format = 'ring'").join(runs.where("domain = 'sequence'"), list(by))
    sequences = spans.groupBy(*by).agg(F.bool_or((F.col("lo") <= F.col("first")) & (F.col("hi") >= F.col("last"))).alias("covered"))
    rows = artifacts.join(bad, list(by), "left").join(bytes_held, list(by), "left").join(sequences, list(by), "left")
    whole = F.when(F.col("format") == "stream", F.col("one") & F.col("from_start")).when(F.col("format") == "ring", F.col("covered"))
    status = F.when(F.col("bad") == 1, "incomplete").when(F.lit(reports_damage) & F.coalesce(whole, F.lit(False)), "complete").otherwise("unknown")
    return rows.select(*by, status.alias("status"))


def worst_provenance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., provenance): the lowest rung of the provenance ladder in each group."""
    return rows.groupBy(*by).agg(F.max_by("provenance", rank_of(F.col("provenance"), PROVENANCES)).alias("provenance"))


def canonical_causes(rows: DataFrame) -> DataFrame:
    """Distinct causes in canonical order."""
    return rows.select("cause").distinct().orderBy(rank_of(F.col("cause"), CAUSES))


#: What, beside damage, keeps missing sequences from being known as overwritten.
DOUBTS = ("covered", "flagged", "incomplete", "stale", "unterminated")


def classify_missing(gaps: DataFrame) -> DataFrame:
    """``gaps`` (.., damaged and any of ``DOUBTS``) with ``cause`` and ``overwritten_sequences``.

    With damage the cause is checksum.  Else gaps are lost where the recording has a coverage gap,
    a flag, an incomplete event, a stale directory entry or an unterminated thread, and overwritten
    only where all such evidence is absent.  ``overwritten_sequences`` asks for damage and coverage alone.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in gaps.columns else F.lit(False)
    doubt = said(DOUBTS[0])
    for c in DOUBTS[1:]:
        doubt = doubt | said(c)
    cause = F.when(said("damaged"), "checksum").when(doubt, "lost").otherwise("overwritten")
    return gaps.withColumn("cause", cause).withColumn("overwritten_sequences", ~said("damaged") & ~said("covered"))


def verdicts(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., provider_complete, complete) over (by.., n_missing, n_damage, n_open, terminal): emptiness of every list."""
    clean = (F.col("n_missing") == 0) & (F.col("n_damage") == 0)
    return facts.groupBy(*by).agg(
        F.bool_and(clean).alias("provider_complete"),
        F.bool_and(clean & (F.col("n_open") == 0) & F.coalesce(F.col("terminal"), F.lit(False))).alias("complete"),
    )
