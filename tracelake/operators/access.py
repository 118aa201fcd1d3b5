"""Row lookups by what a row holds, and the row-set joins that combine them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.u64 import u64_key, u64_literal
from tracelake.operators.calltree import CALL, RETURN
from tracelake.operators.filters import overlaps
from tracelake.schema import KEY, Trace

OWNER = ("artifact", "owner_row AS source_row")


def rows_for_timeline(t: Trace, timeline: int) -> DataFrame:
    return t.events.where(F.col("timeline") == timeline).select("artifact", "source_row")


def rows_for_tids(t: Trace, tids: Sequence[int]) -> DataFrame:
    return t.events.where(F.col("tid").isin(*tids)).select("artifact", "source_row")


def rows_for_sequence_range(t: Trace, lo: int, hi: int) -> DataFrame:
    """Half-open, unlike the filter's inclusive ranges."""
    key = u64_key(F.col("sequence"))
    return t.events.where((key >= u64_key(u64_literal(lo))) & (key < u64_key(u64_literal(hi)))).select("artifact", "source_row")


def rows_of_kinds(t: Trace, kinds: Sequence[str]) -> DataFrame:
    return t.events.where(F.col("kind").isin(*kinds)).select("artifact", "source_row")


def rows_for_modules(t: Trace, modules: Sequence[int]) -> DataFrame:
    """Instruction rows alone."""
    return t.instructions.where(F.col("module").isin(*modules)).selectExpr(*OWNER)


def rows_for_module_pc_range(t: Trace, module: int, lo: int, hi: int) -> DataFrame:
    key = u64_key(F.col("relative_pc"))
    return t.instructions.where((F.col("module") == module) & (key >= u64_key(u64_literal(lo))) & (key < u64_key(u64_literal(hi)))).selectExpr(*OWNER)


def rows_for_definitions(t: Trace, definitions: Sequence[int]) -> DataFrame:
    return t.instructions.where(F.col("definition").isin(*definitions)).selectExpr(*OWNER)


def rows_observing_register(t: Trace, slot: int) -> DataFrame:
    """Rows with any observation of a register, whatever the access."""
    return t.register_obs.where(F.col("slot") == slot).selectExpr(*OWNER).distinct()


def checkpoint_owner_rows(t: Trace) -> DataFrame:
    return t.register_obs.where("access = 'checkpoint'").selectExpr(*OWNER).distinct()


def _flagged(t: Trace, bit: int) -> DataFrame:
    wanted = t.definitions.where(F.col("flags").bitwiseAND(F.lit(bit)) != 0).select("artifact", "definition")
    return t.instructions.join(wanted, ["artifact", "definition"], "left_semi").selectExpr(*OWNER)


def call_rows(t: Trace) -> DataFrame:
    return _flagged(t, CALL)


def return_rows(t: Trace) -> DataFrame:
    return _flagged(t, RETURN)


def rows_for_categories(t: Trace, categories: Sequence[str]) -> DataFrame:
    return t.semantics.where(F.col("category").isin(*categories)).selectExpr(*OWNER)


def rows_for_names(t: Trace, names: Sequence[str]) -> DataFrame:
    return t.semantics.where(F.col("name").isin(*names)).selectExpr(*OWNER)


def memory_overlaps(t: Trace, lo: int, hi: int) -> DataFrame:
    """Accesses that meet [lo, hi); an empty query and accesses without size meet nothing."""
    return t.memory.where(overlaps(F.col("address"), F.col("end_exclusive"), lo, hi) if lo < hi else F.lit(False)).selectExpr(*OWNER)


def row_for_key(t: Trace, keys: DataFrame) -> DataFrame:
    """``keys`` (the key's columns) with their source_row."""
    known = t.events.select(*[F.col(k).alias(f"__{k}") for k in KEY], "source_row")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY])
    return keys.select(*KEY).join(known, match).select(*KEY, "source_row")


def key_for_row(t: Trace, artifact: str, source_row: int) -> DataFrame:
    return t.events.where((F.col("artifact") == artifact) & (F.col("source_row") == source_row)).select(*KEY)


def bounded_rows(rows: DataFrame, cap: int) -> DataFrame:
    """Distinct rows in order; an error as soon as there are more than ``cap``."""
    some = rows.distinct().limit(cap + 1)
    n = some.count()  # at most cap + 1 rows are looked at
    if n > cap:
        raise ValueError(f"more than {cap} rows")
    return some.orderBy("artifact", "source_row")


def row_estimate(rows: DataFrame, cap: int) -> int:
    """An upper bound of the number of rows: exact up to ``cap``, cap + 1 beyond."""
    return rows.limit(cap + 1).count()


def completeness_listing(ranges: DataFrame) -> DataFrame:
    return ranges.orderBy("artifact", "domain", "lo", "hi", "cause")


def intersect_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows that are in all parts, by semi-joins on (artifact, row)."""
    first, *rest = parts
    return reduce(lambda a, b: a.join(b, ["artifact", "source_row"], "left_semi"), rest, first.distinct())


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["artifact", "source_row"], "left_anti")


def same_facts(left: DataFrame, right: DataFrame) -> bool:
    """Whether two passes found the same facts, repeats included."""
    names = left.columns
    return not left.exceptAll(right.select(*names)).take(1) and not right.select(*names).exceptAll(left).take(1)


def module_of(addresses: DataFrame, maps: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(address, module, offset) of the mapping that holds each address; null where none does."""
    from tracelake.operators.intervals import points_in_intervals

    spans = maps.where("size > 0").select("module", F.col("base").alias("lo"), (F.col("base") + F.col("size") - 1).alias("hi")).withColumn("k", F.lit(0))
    found = points_in_intervals(addresses.select("address").distinct().withColumn("k", F.lit(0)), spans, ["k"], width, "address", ("lo", "hi"))
    best = found.groupBy("address").agg(F.max(F.struct("lo", "module")).alias("m"))
    return addresses.join(best, "address", "left").select("address", F.col("m.module").alias("module"), (F.col("address") - F.col("m.lo")).alias("offset"))
