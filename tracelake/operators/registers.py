"""Register state before and after events, from observations and invalidations, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import REGISTERS, truncate_value, width_mask
from tracelake.operators.intervals import carry_forward

SCOPE = ("artifact", "timeline", "tid")


def normalized_observations(obs: DataFrame) -> DataFrame:
    """``obs`` (scope, row, obs_ordinal, slot, captured_width, access, value, provenance, name) with masked values.

    Widths 1 to 8 mask the value; a 4-byte write to a register named w<n> or wsp
    zero-extends, so all bits are known.  Damaged observations are left out.
    """
    mask = width_mask(F.col("captured_width"))
    extends = (F.col("access") == "write") & (F.col("captured_width") == 4) & F.coalesce(F.col("name").rlike("^w([0-9]+|sp)$"), F.lit(False))
    return (
        obs.where("provenance <> 'damaged' AND captured_width BETWEEN 1 AND 8")
        .withColumn("value", truncate_value(F.col("value"), F.col("captured_width")))
        .withColumn("known_mask", F.when(extends, F.lit(-1).cast("bigint")).otherwise(mask))
        .withColumn("phase", F.when(F.col("access") == "write", 1).otherwise(0))
    )


def invalidations(discontinuities: DataFrame, obs: DataFrame) -> DataFrame:
    """(artifact, timeline, row, tid): gaps outside memory, and damaged deltas; a null thread stands for all."""
    gaps = discontinuities.where("domain <> 'memory'").select("artifact", "timeline", "row", "tid")
    deltas = obs.where("access = 'delta' AND provenance = 'damaged'").select("artifact", "timeline", "row", "tid")
    return gaps.unionByName(deltas)


def states_at(targets: DataFrame, obs: DataFrame, broken: DataFrame, replay: DataFrame, slots: int = REGISTERS) -> DataFrame:
    """(scope, target_row, slot, side, value, known_mask, width, provenance, evidence): cells before and after targets.

    ``targets``: scope and row.  ``replay``: scope and row of every replayed event.  A
    cell is the last observation up to the target (before: without the target's own
    writes), unless an invalidation came after it; at one row the observation wins.
    It is captured where its row is the latest replayed event, else derived.

    All targets are answered in one pass: observations and targets of a register are
    put in one order and the last observation is carried forward; invalidations of all
    threads are carried once for the timeline, not once for each thread.
    """
    clean = normalized_observations(obs)
    place = F.col("phase") * F.lit(1 << 20) + F.col("obs_ordinal")
    marks = clean.select(*SCOPE, "slot", F.col("row").alias("at"), place.alias("sub"), F.struct("row", "value", "known_mask", F.col("captured_width").alias("width")).alias("held"))
    asked = targets.select(*SCOPE, "row").distinct()
    last = asked.select(*SCOPE, "row", F.col("row").alias("at"), F.lit(0).alias("sub"))
    gone = broken.select("artifact", "timeline", "tid", F.col("row").alias("at"), F.lit(0).alias("sub"), F.col("row").alias("mark"))
    own = carry_forward(last, gone.where("tid IS NOT NULL"), list(SCOPE), ["mark"]).select(*SCOPE, "row", F.col("mark").alias("own_row"))
    everyone = carry_forward(last, gone.where("tid IS NULL").drop("tid"), ["artifact", "timeline"], ["mark"]).select(*SCOPE, "row", F.col("mark").alias("all_row"))
    seen = carry_forward(last, replay.select(*SCOPE, F.col("row").alias("at"), F.lit(0).alias("sub"), F.col("row").alias("mark")), list(SCOPE), ["mark"]).select(*SCOPE, "row", F.col("mark").alias("replay_row"))
    facts = own.join(everyone, [*SCOPE, "row"]).join(seen, [*SCOPE, "row"]).withColumn("broken_row", F.greatest("own_row", "all_row"))
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.lit((1 << 20) - 1).alias("sub")), F.struct(F.lit("after").alias("side"), F.lit(2**31 - 1).alias("sub"))))
    points = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).select("*", sides.alias("__side")).select("*", F.col("__side.side").alias("side"), F.col("__side.sub").alias("sub"), F.col("row").alias("at")).drop("__side")
    cells = carry_forward(points, marks, [*SCOPE, "slot"], ["held"])
    valid = F.col("held").isNotNull() & ~F.coalesce(F.col("broken_row") > F.col("held.row"), F.lit(False))
    pick = lambda c: F.when(valid, F.col(f"held.{c}"))
    provenance = F.when(~valid, "unknown").when(F.col("held.row") == F.col("replay_row"), "captured").otherwise("derived")
    return cells.select(
        *SCOPE, F.col("row").alias("target_row"), "slot", "side", pick("value").alias("value"),
        F.coalesce(pick("known_mask"), F.lit(0).cast("bigint")).alias("known_mask"), pick("width").alias("width"),
        provenance.alias("provenance"), pick("row").alias("evidence"),
    )


def latest_states(obs: DataFrame) -> DataFrame:
    """(scope, slot, value, row): the last observed value of every register of every thread."""
    clean = normalized_observations(obs)
    return clean.groupBy(*SCOPE, "slot").agg(F.max(F.struct("row", "phase", "obs_ordinal", "value")).alias("x")).select(*SCOPE, "slot", F.col("x.value").alias("value"), F.col("x.row").alias("row"))


def checkpoint_rows(obs: DataFrame) -> DataFrame:
    """Owner rows with a checkpoint observation of every register."""
    found = obs.where("access = 'checkpoint'").groupBy("artifact", "owner_row").agg(F.count("*").alias("n"), F.bit_or(_bit(F.col("slot"))).alias("mask"))
    return found.where((F.col("n") == REGISTERS) & (F.col("mask") == 2**REGISTERS - 1)).select("artifact", "owner_row")


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.cast("int"))


def expand_deltas(deltas: DataFrame) -> DataFrame:
    """Rows (artifact, owner_row, obs_ordinal, slot, value) of (mask, changed[]): values belong to set bits, ascending."""
    slots = F.filter(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    return deltas.select("artifact", "owner_row", F.posexplode(F.arrays_zip(slots.alias("slot"), F.col("changed").alias("value"))).alias("obs_ordinal", "x")).select(
        "artifact", "owner_row", "obs_ordinal", F.col("x.slot").alias("slot"), F.col("x.value").alias("value")
    )
