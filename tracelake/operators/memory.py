"""Memory state, byte by byte, in closed form: no ordered fold, so any number of targets is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.intervals import carry_forward, levels_of, overlap_join, overlap_join_until
from tracelake.operators.ranges import coalesce_ranges

MAX_RANGE, MAX_ROWS = 1 << 20, 10_000
WIDTH, ACCESS_WIDTH = 4096, 16
#: Of ``history``: from how many targets on the tasks of the last join are fixed, and targets for each beyond the usual number.
MANY, TASK_TARGETS = 64, 2048
SPANS = ("lo", "hi"), ("address", "end_exclusive")


def _byte(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def _value_byte(value: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (i * 8).cast("int")).bitwiseAND(F.lit(0xFF)).cast("int")


def check_targets(targets: DataFrame) -> DataFrame:
    """Raises for reversed ranges and for ranges over 1 MiB; empty ranges are allowed."""
    size = F.col("hi") - F.col("lo")
    bad = F.when(size < 0, F.raise_error(F.lit("reversed range"))).when(size > MAX_RANGE, F.raise_error(F.lit("range over 1 MiB")))
    return targets.withColumn("lo", F.coalesce(bad.cast("bigint"), F.col("lo")))


def _until(targets: DataFrame, accesses: DataFrame, levels: list[int], tasks: int | None = None) -> DataFrame:
    """Accesses that overlap each target's range (lo, hi), up to its ``t_row``."""
    a = accesses.select("artifact", "timeline", "row", "tid", "address", "end_exclusive", "size", "direction")
    return overlap_join_until(targets, a, ["artifact", "timeline"], ACCESS_WIDTH, *SPANS, "t_row", "row", levels, tasks)


def _bytes_of(rows: DataFrame, length: Column) -> DataFrame:
    """A row for each byte in the target's range that the first ``length`` bytes of an access cover."""
    first = F.greatest(F.lit(0).cast("bigint"), F.col("lo") - F.col("address"))
    stop = F.least(length.cast("bigint"), F.col("hi") - F.col("address"))
    cut = rows.withColumn("__first", first).withColumn("__stop", stop).where("__first < __stop")
    return cut.withColumn("i", F.explode(F.sequence(F.col("__first"), F.col("__stop") - 1))).withColumn("byte_at", F.col("address") + F.col("i")).drop("__first", "__stop")


def state_at(targets: DataFrame, memory: DataFrame, discontinuities: DataFrame, global_ordering: bool = True) -> DataFrame:
    """Cells (target, address) with value, provenance and evidence of last_written, observed, before and after.

    ``targets``: artifact, timeline, target, row, tid, lo, hi.  ``memory``: artifact,
    timeline, row, tid, address, end_exclusive, size, direction, metadata_available,
    value, before and after (state, bytes).  ``discontinuities``: artifact, timeline,
    row, tid, domain, lo, hi.  Bytes of writes that weren't captured have no effect;
    unavailable ones damage; damage after the last write hides it.  Without a global
    order other threads' writes, whenever they were, damage the bytes they touch.
    """
    no_thread = F.lit(-1).cast("bigint")  # thread ids are unsigned 32-bit, so this is none of them
    targets = check_targets(targets)
    bytes_ = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("byte_at")
    place = ["artifact", "timeline", "byte_at"]
    cells = targets.where("lo < hi").select("artifact", "timeline", "target", F.col("row").alias("t_row"), F.col("tid").alias("t_tid"), bytes_)
    # Each write is cut into bytes once, however many targets ask for them.
    asked = coalesce_ranges(targets.where("lo < hi").select("artifact", "timeline", "lo", "hi").distinct(), ["artifact", "timeline"], inclusive=False)
    writes = overlap_join(asked, memory.where("direction IN ('write', 'read_write')"), ["artifact", "timeline"], WIDTH, ("lo", "hi"), ("address", "end_exclusive"))
    damaged = F.col("after.state") == "unavailable"
    length = F.when(damaged, F.col("size")).otherwise(F.least(F.octet_length("after.bytes").cast("bigint"), F.col("size")))
    effective = _bytes_of(writes.where("after.state <> 'not_captured'"), length).select(
        *place, F.coalesce("tid", no_thread).alias("tid"), F.col("row").alias("at"), F.lit(1).alias("sub"), F.struct("row", F.when(~damaged, _byte(F.col("after.bytes"), F.col("i"))).alias("value"), damaged.alias("damaged"), "tid").alias("w")
    )
    # Discontinuities: the latest that covers a byte, for all threads and for the target's own.
    gone = discontinuities.select("artifact", "timeline", "tid", "domain", "lo", "hi", F.col("row").alias("at"), F.lit(1).alias("sub"), F.col("row").alias("mark"))
    spans = gone.where("domain = 'memory' AND lo < hi").select("artifact", "timeline", "tid", "at", "sub", "mark", F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"))
    local = overlap_join(asked, spans, ["artifact", "timeline"], WIDTH, ("lo", "hi"), ("d_lo", "d_hi"))
    cut = F.explode(F.sequence(F.greatest("lo", "d_lo"), F.least("hi", "d_hi") - 1)).alias("byte_at")
    local = local.select("artifact", "timeline", "tid", "at", "sub", "mark", cut)
    # Marks of all threads on bytes: writes (seen by later rows) and damage (seen by its own row too).
    damage_all = local.where("tid IS NULL").select(*place, "at", F.lit(-1).alias("sub"), F.col("mark").alias("la"))
    cells = cells.withColumn("at", F.col("t_row")).withColumn("sub", F.lit(0)).withColumn("tid", F.coalesce("t_tid", no_thread))
    if global_ordering:
        marks = effective.drop("tid").unionByName(damage_all, allowMissingColumns=True)
        cells = carry_forward(cells, marks, place, ["w", "la"])
        cells = carry_forward(cells, local.where("tid IS NOT NULL").select(*place, "tid", "at", F.lit(-1).alias("sub"), F.col("mark").alias("lo_")), [*place, "tid"], ["lo_"])
    else:
        marks = effective.unionByName(local.where("tid IS NOT NULL").select(*place, "tid", "at", F.lit(-1).alias("sub"), F.col("mark").alias("lo_")), allowMissingColumns=True)
        cells = carry_forward(cells, marks, [*place, "tid"], ["w", "lo_"])
        cells = carry_forward(cells, damage_all, place, ["la"])
    # Damage of whole ranges depends on the target alone.
    whole = gone.where("domain <> 'memory'").select("artifact", "timeline", "tid", "at", F.lit(-1).alias("sub"), "mark")
    ends = targets.select("artifact", "timeline", "target", "tid", F.col("row").alias("at"), F.lit(0).alias("sub"))
    by_all = carry_forward(ends, whole.where("tid IS NULL").drop("tid"), ["artifact", "timeline"], ["mark"]).select("target", F.col("mark").alias("da"))
    by_own = carry_forward(ends, whole.where("tid IS NOT NULL"), ["artifact", "timeline", "tid"], ["mark"]).select("target", F.col("mark").alias("do"))
    cells = cells.join(by_all, "target", "left").join(by_own, "target", "left")
    d_all, d_own = F.greatest("da", "la"), F.greatest("do", "lo_")
    hidden = F.when(F.col("w").isNull(), d_all.isNotNull() | d_own.isNotNull()).otherwise(
        F.coalesce(d_all > F.col("w.row"), F.lit(False)) | F.coalesce((d_own > F.col("w.row")) & F.col("w.tid").eqNullSafe(F.col("t_tid")), F.lit(False))
    )
    if global_ordering:
        conflict = F.lit(False)
    else:
        who = _bytes_of(writes, F.col("size")).groupBy(*place).agg(F.min("tid").alias("w_min"), F.max("tid").alias("w_max"), F.bool_or(F.col("tid").isNull()).alias("w_none"))
        cells = cells.join(who, place, "left")
        other = (F.col("w_min") != F.col("t_tid")) | (F.col("w_max") != F.col("t_tid")) | F.col("w_none")
        conflict = F.coalesce(F.when(F.col("t_tid").isNull(), F.col("w_min").isNotNull()).otherwise(other), F.lit(False))
    broken = hidden | conflict | F.coalesce("w.damaged", F.lit(False))
    cell = lambda value, provenance, evidence: F.struct(value.alias("value"), provenance.alias("provenance"), evidence.alias("evidence"))
    none_i, none_l = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    damage = cell(none_i, F.lit("damaged"), F.when(~hidden & ~conflict, F.col("w.row")))
    unknown = cell(none_i, F.lit("unknown"), none_l)
    written = F.when(broken, damage).when(F.col("w").isNotNull(), cell(F.col("w.value"), F.lit("derived"), F.col("w.row"))).otherwise(unknown)
    cells = cells.withColumn("last_written", written).withColumn("__conflict", conflict).select("artifact", "timeline", "target", "t_row", "byte_at", "last_written", "__conflict")

    # The target's own access.
    at = targets.select("artifact", "timeline", "target", "row", "lo", "hi").join(memory.drop("tid"), ["artifact", "timeline", "row"]).where("address < end_exclusive")
    own_bytes = _bytes_of(at, F.col("size")).select(
        "target", "byte_at", F.col("row").alias("o_row"), "direction", "metadata_available",
        F.when(F.col("metadata_available") & (F.col("i") < 8), _value_byte(F.col("value"), F.col("i"))).alias("seen"),
        *[
            F.struct(F.col(f"{s}.state").alias("state"), F.when(F.col("i") < F.octet_length(f"{s}.bytes"), _byte(F.col(f"{s}.bytes"), F.col("i"))).alias("value")).alias(f"o_{s}")
            for s in ("before", "after")
        ],
    )
    rows = cells.join(own_bytes, ["target", "byte_at"], "left")

    def overlaid(base: Column, side: str, when: Column) -> Column:
        c = F.col(f"o_{side}")
        caught = cell(c["value"], F.lit("captured"), F.col("o_row"))
        lost = cell(none_i, F.lit("damaged"), F.col("o_row"))
        return F.when(F.col("__conflict") | c.isNull() | ~F.coalesce(when, F.lit(False)), base).when(c["state"] == "unavailable", lost).when((c["state"] == "available") & c["value"].isNotNull(), caught).otherwise(base)

    observed = F.when(F.col("seen").isNotNull(), cell(F.col("seen"), F.lit("captured"), F.col("o_row"))).otherwise(unknown)
    rows = rows.withColumn("observed", observed).withColumn("before", overlaid(F.col("last_written"), "before", F.lit(True)))
    rows = rows.withColumn("after", overlaid(F.col("before"), "after", F.col("direction").isin("write", "read_write")))
    return rows.select("artifact", "timeline", "target", F.col("byte_at").alias("address"), "observed", "before", "after", "last_written")


def history(targets: DataFrame, memory: DataFrame, cap: int = MAX_ROWS) -> DataFrame:
    """Accesses of all threads that overlap a target's range, up to its row; over ``cap`` of them is an error.

    Targets with the same range have at most as many as the latest of them, so one count for each range decides,
    before any pair is made.
    """
    span = ["artifact", "timeline", "lo", "hi"]
    targets = check_targets(targets)
    n = F.count("*")
    over = F.when(n > cap, F.raise_error(F.lit("too many overlapping rows"))).otherwise(F.lit(True)).cast("boolean")
    levels, asked = levels_of(targets, memory, ACCESS_WIDTH, *SPANS)
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked // TASK_TARGETS) if asked >= MANY else None
    held = _until(targets.groupBy(*span).agg(F.max("row").alias("t_row")), memory, levels).groupBy(*span).agg(over.alias("ok"))
    allowed = targets.join(held, span).where("ok").select(*span, "target", F.col("row").alias("t_row"))
    return _until(allowed, memory, levels, tasks).select("target", "row", "tid", "address", "size", "direction")


def capture_state(length: Column, state: Column) -> Column:
    """A captured side as text: its state, or its bytes in lower-case hex."""
    return F.when(state == "not_captured", "<not-captured>").when(state == "unavailable", "<unavailable>").otherwise(F.lower(F.hex(length)))
