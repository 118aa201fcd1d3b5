"""Semantic details as typed rows: scene boundaries and syscall evidence, with strict validation.

A detail that isn't an object with exactly the expected keys (none twice), or whose
values leave their ranges, is kept with ``valid`` false and counted, never guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import is_hex64, parse_hex64, strict_object
from tracelake.functions.u64 import TWO_64, WIDE, u64_from_dec

# Fixed values of the formats.
SCENE_KEYS = frozenset(("schema", "id", "phase", "address", "monotonicNs", "returnValue"))
SCENE = "schema int, id decimal(38,0), phase string, address string, monotonicNs decimal(38,0), returnValue string"
PHASES = ("enter", "return", "capture_stopped")
ENTER_KEYS = {1: frozenset(("schema", "id", "number", "pc", "args", "path")), 2: frozenset(("schema", "id", "number", "pc", "args", "paths"))}
RETURN_KEYS = frozenset(("schema", "id", "number", "pc", "observed", "rawReturn", "linuxErrorNumber", "reason"))
PATH = "struct<argument:int,address:string,status:string,limit:int,bytesHex:string,display:string>"
ENTER = f"schema int, id decimal(38,0), number decimal(38,0), pc string, args array<string>, path {PATH}, paths array<{PATH}>"
RETURN = "schema int, id decimal(38,0), number decimal(38,0), pc string, observed boolean, rawReturn string, linuxErrorNumber int, reason string"
UNOBSERVED = ("signal_intervened", "unexpected_pc", "post_not_observed", "capture_ended")
OPENAT = 56
MAX_SCENE_DETAIL, MAX_SYSCALL_DETAIL = 512, 4096


def _all(tests: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _u64(c: Column, least: int) -> Column:
    return (c >= least) & (c < F.lit(TWO_64).cast(WIDE))


def scene_boundaries(rules: DataFrame, rule_name: str) -> DataFrame:
    """(artifact, tid, seq, id, phase, address, ns, return_value, valid) of the rules with a name.

    ``rules``: artifact, tid, seq, name, detail.  Addresses and returns are hexadecimal
    texts; a return value belongs to returns alone.
    """
    mine = rules.where(F.col("name") == rule_name)
    d = F.from_json("detail", SCENE)
    rows = mine.select("artifact", "tid", "seq", d.alias("d"), strict_object(F.col("detail"), SCENE_KEYS).alias("strict"), F.octet_length("detail").alias("size"))
    returned = F.col("d.returnValue")
    fits = F.when(F.col("d.phase") == "return", is_hex64(returned)).otherwise(returned.isNull())
    valid = _all([
        F.col("strict"), F.col("size") <= MAX_SCENE_DETAIL, F.col("d.schema") == 1, _u64(F.col("d.id"), 1), _u64(F.col("d.monotonicNs"), 0),
        F.col("d.phase").isin(*PHASES), is_hex64(F.col("d.address")), fits,
    ])
    return rows.select(
        "artifact", "tid", "seq", u64_from_dec(F.col("d.id")).alias("id"), F.col("d.phase").alias("phase"), parse_hex64(F.col("d.address")).alias("address"),
        u64_from_dec(F.col("d.monotonicNs")).alias("ns"), parse_hex64(returned).alias("return_value"), valid.alias("valid"),
    )


def _path_fits(p: Column, args: Column) -> Column:
    size = F.length(p["bytesHex"]) / 2
    by_status = (
        F.when(p["status"] == "complete", size <= 127)
        .when(p["status"] == "unreadable", size == 0)
        .when(p["status"] == "partial", size.between(1, 127))
        .when(p["status"] == "truncated", size == 128)
    )
    at = F.get(args, p["argument"])
    return F.coalesce(p["argument"].between(0, 5) & (p["address"] == at) & (p["limit"] == 128) & p["bytesHex"].rlike("^([0-9a-f]{2})*$") & by_status, F.lit(False))


def syscalls(calls: DataFrame) -> DataFrame:
    """(artifact, tid, seq, id, phase, number, pc, schema, raw_return, valid) for ``pair_syscalls``.

    ``calls``: artifact, tid, seq, category (syscall-enter or syscall-return), detail.  An
    enter without an id is a legacy one.  Raw returns must agree with their error numbers.
    """
    enter, ret = F.from_json("detail", ENTER), F.from_json("detail", RETURN)
    mine = calls.where(F.col("category").isin("syscall-enter", "syscall-return"))
    rows = mine.select(
        "artifact", "tid", "seq", "category", enter.alias("e"), ret.alias("r"), F.octet_length("detail").alias("size"),
        *[strict_object(F.col("detail"), ENTER_KEYS[k]).alias(f"enter{k}") for k in ENTER_KEYS], strict_object(F.col("detail"), RETURN_KEYS).alias("return2"),
    )
    e, r = F.col("e"), F.col("r")
    paths = F.when(e["schema"] == 1, F.array_compact(F.array(e["path"]))).otherwise(e["paths"])
    one_path = F.when(e["schema"] == 1, F.when(e["number"] == OPENAT, F.coalesce(e["path"]["argument"] == 1, F.lit(False))).otherwise(e["path"].isNull())).otherwise((F.size(paths) <= 2) & (F.size(F.array_distinct(F.transform(paths, lambda p: p["argument"]))) == F.size(paths)))
    entered = _all([
        F.when(e["schema"] == 1, F.col("enter1")).when(e["schema"] == 2, F.col("enter2")), _u64(e["id"], 1), is_hex64(e["pc"]), F.size(e["args"]) == 6,
        F.forall(e["args"], is_hex64), one_path, F.forall(paths, lambda p: _path_fits(p, e["args"])),
    ])
    raw = parse_hex64(r["rawReturn"])
    error = F.when(raw.between(-4095, -1), (-raw).cast("int"))
    seen = (r["reason"] == "post_instruction") & is_hex64(r["rawReturn"]) & r["linuxErrorNumber"].eqNullSafe(error)
    unseen = r["rawReturn"].isNull() & r["linuxErrorNumber"].isNull() & r["reason"].isin(*UNOBSERVED)
    came_back = _all([F.col("return2"), r["schema"].isin(1, 2), _u64(r["id"], 1), is_hex64(r["pc"]), F.when(r["observed"], seen).otherwise(unseen)])
    is_enter = F.col("category") == "syscall-enter"
    legacy = is_enter & e["id"].isNull() & e["schema"].isNull()
    pick = lambda name: F.when(is_enter, e[name]).otherwise(r[name])
    return rows.select(
        "artifact", "tid", "seq", u64_from_dec(pick("id")).alias("id"), F.when(is_enter, "enter").otherwise("return").alias("phase"), pick("number").cast("bigint").alias("number"),
        parse_hex64(pick("pc")).alias("pc"), F.coalesce(pick("schema"), F.lit(0)).alias("schema"), F.when(~is_enter, raw).alias("raw_return"),
        ((F.col("size") <= MAX_SYSCALL_DETAIL) & (legacy | F.when(is_enter, entered).otherwise(came_back))).alias("valid"),
    )


def invalid_count(rows: DataFrame) -> DataFrame:
    """(artifact, invalid): details that don't hold, by artifact."""
    return rows.groupBy("artifact").agg(F.count_if(~F.col("valid")).alias("invalid"))
