"""Pairing: scene, syscall and signal boundaries, thread balances, policies in effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.intervals import carry_rows, running_sum

KEPT_SCENES = 256


def pair_boundaries(boundaries: DataFrame, key: Sequence[str], same: Sequence[str] = ("address",)) -> DataFrame:
    """(key.., entry, ending, state, entry_ns, ending_ns, valid): a full outer join of enters and ends.

    ``boundaries`` has key.., seq, phase (enter, return, capture_stopped), ns and the
    columns of ``same``.  A pair is valid when those agree, the end is later and time
    doesn't go back; an invalid pair is consumed and counted, not split again.  A second
    enter or end of a key is an error, raised by the query that meets it.
    """
    def one(rows: DataFrame, prefix: str) -> DataFrame:
        grouped = rows.groupBy(*key).agg(
            F.count("*").alias("n"), F.min(F.struct("seq", "ns", *same, "phase")).alias("x")
        )
        once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {prefix} boundary of "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))).otherwise(F.col("x"))
        return grouped.select(*key, once.alias(prefix))

    enters = one(boundaries.where("phase = 'enter'"), "enter")
    ends = one(boundaries.where("phase <> 'enter'"), "end")
    both = enters.join(ends, list(key), "full_outer")
    agree = (F.col("enter.seq") < F.col("end.seq")) & (F.col("enter.ns") <= F.col("end.ns"))
    for s in same:
        agree = agree & F.col(f"enter.{s}").eqNullSafe(F.col(f"end.{s}"))
    state = F.when(F.col("end").isNull(), "open_at_end").when(F.col("enter").isNull(), "orphan").when(~agree, "invalid").otherwise(
        F.when(F.col("end.phase") == "return", "returned").otherwise(F.col("end.phase"))
    )
    return both.select(
        *key,
        F.col("enter.seq").alias("entry"),
        F.col("end.seq").alias("ending"),
        F.col("enter.ns").alias("entry_ns"),
        F.col("end.ns").alias("ending_ns"),
        *[F.coalesce(F.col(f"enter.{s}"), F.col(f"end.{s}")).alias(s) for s in same],
        state.alias("state"),
    )


def next_boundary_pairs(rows: DataFrame, by: str, seq: str, is_enter: Column, is_end: Column) -> DataFrame:
    """(by, entry, ending, state): every enter with the next end of the same thread before another enter; else open.

    Ends without an open enter are orphans and left out.
    """
    marked = rows.where(is_enter | is_end).select(by, F.col(seq).alias("seq"), is_enter.alias("enter"))
    following = carry_rows(marked, [by], "seq", {"next": F.struct("seq", "enter")}, back=True, strict=True)
    ending = F.when(~F.col("next.enter"), F.col("next.seq"))
    return following.where("enter").select(by, F.col("seq").alias("entry"), ending.alias("ending"), F.when(ending.isNull(), "open_at_end").otherwise("returned").alias("state"))


def lifecycle(boundaries: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key.., address, entry, entry_ns, last_seq, state, target_returned, invalid): what became of each scene.

    A boundary with another address than the scene's first, or with a time before that of an
    earlier good one, is ignored and counted as invalid.  The last good boundary decides:
    open_at_end, returned or capture_stopped.  A return proves that the target returned, also
    without an enter; nothing else proves anything.  ``boundaries``: key.., seq, phase, ns, address.
    """
    order = Window.partitionBy(*key).orderBy("seq")
    first = boundaries.withColumn("__address", F.first("address").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("address").eqNullSafe(F.col("__address"))
    # A good boundary's time is the greatest so far, and a bad one's of this address is below it.
    upto = F.max(F.when(same, F.col("ns"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    judged = first.withColumn("__good", same & F.coalesce(F.col("ns") >= upto, F.lit(True)))
    good = lambda c: F.when(F.col("__good"), c)
    entered = F.when(F.col("__good") & (F.col("phase") == "enter"), F.struct("seq", "ns"))
    rows = judged.groupBy(*key).agg(
        F.first("__address").alias("address"), F.max(entered).alias("e"), F.max(good(F.struct("seq", "phase"))).alias("x"), F.count_if(~F.col("__good")).alias("invalid")
    )
    state = F.when(F.col("x.phase") == "enter", "open_at_end").when(F.col("x.phase") == "return", "returned").otherwise(F.col("x.phase"))
    return rows.select(
        *key, "address", F.col("e.seq").alias("entry"), F.col("e.ns").alias("entry_ns"), F.col("x.seq").alias("last_seq"), state.alias("state"),
        F.when(F.col("x.phase") == "return", F.lit(True)).alias("target_returned"), "invalid",
    )


def newest(rows: DataFrame, order: str, keep: int = KEPT_SCENES, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``keep`` rows (of each group) and ``omitted``, the number left out."""
    if not by:
        total = rows.agg(F.count("*").alias("n"))
        top = rows.orderBy(F.col(order).desc()).limit(keep)
        return top.join(F.broadcast(total)).withColumn("omitted", F.greatest(F.lit(0).cast("bigint"), F.col("n") - keep)).drop("n")  # one row
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc())))
    total = F.count("*").over(Window.partitionBy(*by))
    return ranked.withColumn("omitted", F.greatest(F.lit(0).cast("bigint"), total - keep)).where(F.col("__r") <= keep).drop("__r")


def scene_summary(scenes: DataFrame, limit: int = 256) -> DataFrame:
    """By address: scenes with an entry, returned ones, instructions, first entry, last end; newest first entries first."""
    return (
        scenes.groupBy("address")
        .agg(
            F.count("entry").alias("entries"),
            F.count_if(F.col("state") == "returned").alias("returned"),
            F.sum("instructions").alias("instructions"),
            F.min("entry").alias("first_entry"),
            F.max("ending").alias("last_ending"),
        )
        .orderBy(F.col("first_entry").desc(), "address")
        .limit(limit)
    )


def omitted_groups(rows: DataFrame, column: str, shown: int) -> DataFrame:
    """(omitted): distinct groups beyond the ``shown`` ones."""
    return rows.agg(F.greatest(F.lit(0).cast("bigint"), F.count_distinct(column) - shown).alias("omitted"))


def count_inside(scenes: DataFrame, events: DataFrame, by: str, seq: str) -> DataFrame:
    """``scenes`` (by, entry, ending) with ``instructions``: events of the thread with entry <= seq <= ending.

    Two running counts at the bounds are subtracted: one pass, however long or nested the scenes are.
    """
    marks = events.select(by, F.col(seq).alias("at"), F.lit(1).alias("what"), F.lit(None).cast("bigint").alias("entry"))
    starts = scenes.select(by, F.col("entry").alias("at"), F.lit(0).alias("what"), "entry")
    stops = scenes.where("ending IS NOT NULL").select(by, F.col("ending").alias("at"), F.lit(2).alias("what"), "entry")
    counted = running_sum(marks.unionByName(starts).unionByName(stops), [by], "at", F.when(F.col("what") == 1, 1).otherwise(0), "n", "what")
    inside = counted.where("what <> 1").groupBy(by, "entry").agg(
        (F.max(F.when(F.col("what") == 2, F.col("n"))) - F.max(F.when(F.col("what") == 0, F.col("n")))).alias("instructions")
    )
    return scenes.join(inside, [by, "entry"], "left")


def scene_boundaries_between(boundaries: DataFrame, since: int, until: int, after: int, n: int) -> DataFrame:
    """The first ``n`` boundaries by seq with since <= ns <= until and seq > after."""
    return boundaries.where((F.col("ns") >= since) & (F.col("ns") <= until) & (F.col("seq") > after)).orderBy("seq").limit(n)


def scenes_between(scenes: DataFrame, since: int, until: int) -> DataFrame:
    """Paired scenes whose closed time span meets since..until."""
    return scenes.where((F.col("entry_ns") <= until) & (F.col("ending_ns") >= since))


def membership(scenes: DataFrame, gaps: DataFrame, at: int, doubts: Sequence[str] = ()) -> DataFrame:
    """``scenes`` with membership (observed or uncertain) and its reasons at a sequence.

    ``gaps`` (lo, hi, reason) that meet entry..at make membership uncertain, as do a missing entry
    and any of ``doubts`` (of the whole recording).  Without an entry there is no range to hold against gaps,
    but a coverage gap at the very sequence counts.
    """
    bounds = gaps.where(F.col("lo") <= at).groupBy("reason").agg(F.max("hi").alias("upto"))  # a row for each reason
    reasons = bounds.agg(F.collect_list(F.struct("reason", "upto")).alias("known"))
    rows = scenes.join(F.broadcast(reasons))  # one row of as many entries as there are reasons
    start = F.coalesce("entry", F.lit(at))
    found = F.transform(F.filter("known", lambda g: (g["upto"] >= start) & (F.col("entry").isNotNull() | (g["reason"] == "coverage_gap"))), lambda g: g["reason"])
    own = F.array(F.when(F.col("entry").isNull(), "missing_entry"), *[F.lit(x) for x in doubts])
    why = F.array_sort(F.array_distinct(F.array_compact(F.concat(own, found))))
    return rows.withColumn("reasons", why).withColumn("membership", F.when(F.size("reasons") > 0, "uncertain").otherwise("observed")).drop("known")


def pair_syscalls(rows: DataFrame) -> DataFrame:
    """(tid, id, entry, ending, number, outcome, raw_return, error): enters and returns of (tid, id).

    Number, pc and schema must agree and the return must be later; a second enter or
    return of a key raises, orphan returns and legacy enters are rows of their own.
    """
    def one(part: DataFrame, name: str, extra: list[str]) -> DataFrame:
        grouped = part.groupBy("tid", "id").agg(F.count("*").alias("n"), F.first(F.struct("seq", "number", "pc", "schema", *extra)).alias("x"))
        once = F.when(F.col("n") > 1, F.raise_error(F.lit(f"duplicate syscall {name}"))).otherwise(F.col("x"))
        return grouped.select("tid", "id", once.alias(name))

    legacy = rows.where("phase = 'enter' AND id IS NULL")
    enters = one(rows.where("phase = 'enter' AND id IS NOT NULL"), "enter", [])
    returns = one(rows.where("phase = 'return'"), "ret", ["raw_return"])
    both = enters.join(returns, ["tid", "id"], "full_outer")
    agree = (F.col("enter.number") == F.col("ret.number")) & F.col("enter.pc").eqNullSafe(F.col("ret.pc"))
    agree = agree & (F.col("enter.schema") == F.col("ret.schema")) & (F.col("ret.seq") > F.col("enter.seq"))
    outcome = F.when(F.col("ret").isNull(), "open").when(F.col("enter").isNull(), "orphan_return").when(agree, "paired").otherwise(F.raise_error(F.lit("syscall return does not match its enter")))
    raw = F.col("ret.raw_return")
    paired = both.select(
        "tid", "id", F.col("enter.seq").alias("entry"), F.col("ret.seq").alias("ending"),
        F.coalesce(F.col("enter.number"), F.col("ret.number")).alias("number"), outcome.alias("outcome"), raw.alias("raw_return"),
        F.when(raw.between(-4095, -1), -raw).alias("error"),
    )
    old = legacy.select("tid", "id", F.col("seq").alias("entry"), F.lit(None).cast("bigint").alias("ending"), "number", F.lit("legacy_enter").alias("outcome"), F.lit(None).cast("bigint").alias("raw_return"), F.lit(None).cast("bigint").alias("error"))
    return paired.unionByName(old)


def open_signals(boundaries: DataFrame) -> DataFrame:
    """Handler begins without a return; a return names its begin's sequence in ``begin_seq``."""
    begins = boundaries.where("phase = 'begin'").select("tid", F.col("seq").alias("begin_seq"), "signal")
    returns = boundaries.where("phase = 'return'").select("tid", "begin_seq")
    return begins.join(returns, ["tid", "begin_seq"], "left_anti")


def thread_balance(rows: DataFrame) -> DataFrame:
    """(tid, balance): begins less ends of each thread; a positive balance is an unterminated thread."""
    step = F.when(F.col("phase") == "begin", 1).when(F.col("phase") == "end", -1).otherwise(0)
    return rows.groupBy("tid").agg(F.sum(step).alias("balance"))


def last_of_threads(events: DataFrame) -> DataFrame:
    """(tid, last_seq, last_kind) of each thread."""
    newest_row = F.max(F.struct("sequence", "kind"))
    return events.where("tid IS NOT NULL").groupBy("tid").agg(newest_row.alias("x")).select("tid", F.col("x.sequence").alias("last_seq"), F.col("x.kind").alias("last_kind"))


def last_recorded_thread(events: DataFrame) -> DataFrame:
    """(sequence, tid) of the last event; of equal sequences the larger thread."""
    return events.agg(F.max(F.struct("sequence", "tid")).alias("x")).select("x.sequence", "x.tid")


def policy_in_effect(rows: DataFrame, is_rule: Column, matches: Column, by: str = "tid", seq: str = "sequence") -> DataFrame:
    """``rows`` with ``in_effect``: whether the thread's last policy rule up to the row is the wanted one.

    A later rule with another text switches the policy off; before any rule it is off.
    """
    said = carry_rows(rows, [by], seq, {"in_effect": F.when(is_rule, F.coalesce(matches, F.lit(False)))})
    return said.withColumn("in_effect", F.coalesce("in_effect", F.lit(False)))


def pc_source(in_effect: Column, flags: Column, is_return: Column) -> Column:
    """Where a signal's pc comes from: by the policy in effect and the nesting depth in the low 16 flag bits."""
    depth = flags.bitwiseAND(F.lit(0xFFFF))
    return (
        F.when(~F.coalesce(in_effect, F.lit(False)) | (depth == 0), "unknown").when(is_return, "guest_handler_context").when(depth == 1, "qbdi_logical").otherwise("kernel_ucontext")
    )
