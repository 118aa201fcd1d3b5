"""The driver's star tables read as a trace, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.schema import Trace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, tid, etype, kind, k, ns, value, props) of ``events``."""
    kind = F.create_map(
        *[F.lit(x) for x in ("signup", "semantic_call", "click", "semantic_rule", "error", "semantic_error", "view", "memory", "purchase", "instruction")]
    )
    ns = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("r"),
        F.col("user_id").alias("tid"),
        F.col("event_type").alias("etype"),
        F.element_at(kind, F.col("event_type")).alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        ns.alias("ns"),
        "value",
        "props",
    )


FLAGS = {"signup": 4, "purchase": 8, "view": 1, "click": 0}
MNEMONICS = {"signup": "BL", "purchase": "RET", "view": "B", "click": "ADD"}


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    rows = log(spark, sf_dir)
    r = F.col("r")
    artifact, timeline = F.lit("a").alias("artifact"), F.lit(0).cast("bigint").alias("timeline")
    events = rows.select(
        artifact, timeline, r.alias("record_ordinal"), r.alias("source_offset"), r.alias("sequence"), "tid", r.alias("source_row"), "kind", F.lit("captured").alias("provenance")
    )
    modules = spark.range(4).select(artifact, F.col("id").alias("module"), (4096 * (F.col("id") + 1)).alias("base"), F.concat(F.lit("lib"), F.col("id")).alias("name"))
    number = {t: i for i, t in enumerate(FLAGS)}
    definitions = spark.createDataFrame([("a", number[t], FLAGS[t], MNEMONICS[t], "x0, x1") for t in FLAGS], "artifact string, definition bigint, flags bigint, mnemonic string, operands string")
    numbers = F.create_map(*[F.lit(x) for t in number for x in (t, number[t])])
    code = rows.where("etype <> 'error'").select(
        artifact, r.alias("owner_row"), F.pmod("tid", F.lit(4)).alias("module"), (F.col("k") * 4).alias("relative_pc"), F.element_at(numbers, F.col("etype")).cast("bigint").alias("definition")
    )
    size = 1 + F.pmod(r, F.lit(16))
    state = F.when(F.pmod(r, F.lit(5)) == 0, "unavailable").when(F.pmod(r, F.lit(5)) == 1, "not_captured").otherwise("available")
    byte = F.lpad(F.hex(F.pmod(r, F.lit(256))), 2, "0")
    none = F.struct(F.lit("not_captured").alias("state"), F.lit(None).cast("binary").alias("bytes"))
    written = F.struct(state.alias("state"), F.when(state == "available", F.unhex(F.repeat(byte, size.cast("int")))).alias("bytes"))
    memory = rows.where("etype IN ('view', 'purchase')").select(
        artifact, timeline, r.alias("owner_row"), r.alias("row"), "tid", F.pmod("tid", F.lit(4)).alias("module"), (F.col("k") * 4).alias("relative_pc"),
        (F.col("k") * 8).alias("address"), (F.col("k") * 8 + size).alias("end_exclusive"), size.alias("size"),
        F.when(F.col("etype") == "view", "read").otherwise("write").alias("direction"), (F.pmod(r, F.lit(3)) != 0).alias("metadata_available"),
        r.alias("value"), none.alias("before"), F.when(F.col("etype") == "view", none).otherwise(written).alias("after"),
    )
    semantics = rows.where("kind LIKE 'semantic%'").select(
        artifact, r.alias("owner_row"), F.col("etype").alias("category"), F.concat(F.lit("n"), F.pmod("k", F.lit(10))).alias("name"), F.col("props").alias("detail")
    )
    register_obs = rows.where("etype IN ('click', 'purchase')").select(
        artifact, timeline, "tid", r.alias("owner_row"), r.alias("row"), F.lit(0).alias("obs_ordinal"), F.pmod("k", F.lit(34)).cast("int").alias("slot"),
        F.lit(8).alias("captured_width"), F.when(F.col("etype") == "click", "read").otherwise("write").alias("access"), r.alias("value"),
        F.lit("captured").alias("provenance"), F.lit("x").alias("name"),
    )
    discontinuities = rows.where("etype = 'error'").select(
        artifact, timeline, r.alias("row"), F.when(F.pmod(r, F.lit(2)) == 0, F.col("tid")).alias("tid"),
        F.when(F.pmod("k", F.lit(2)) == 0, "memory").otherwise("sequence").alias("domain"), (F.col("k") * 8).alias("lo"), (F.col("k") * 8 + 16).alias("hi"),
    )
    return Trace(events, modules, definitions, code, memory, semantics, register_obs, discontinuities)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for next pcs and call trees: signup calls, purchase returns, view branches, click plain, error a barrier."""
    rows = log(spark, sf_dir)
    flags = F.create_map(*[F.lit(x) for t, f in FLAGS.items() for x in (t, f)])
    return rows.select(
        F.lit("a").alias("artifact"), F.lit(0).cast("bigint").alias("timeline"), "tid", F.col("r").alias("row"),
        F.when(F.col("etype") == "error", "discontinuity").otherwise("instruction").alias("kind"),
        F.when(F.col("etype") != "error", F.col("k") * 4).alias("pc"), F.coalesce(F.element_at(flags, F.col("etype")), F.lit(0)).cast("bigint").alias("flags"),
        (F.pmod("k", F.lit(7)) * 4).alias("displacement"), F.pmod("k", F.lit(3)).cast("int").alias("pc_kind"),
        F.lit(None).cast("array<struct<slot:int,value:bigint>>").alias("reads"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("name"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, entry, ending, state, address): each signup with the user's next purchase, unless another signup comes first."""
    from tracelake.operators.pairing import next_boundary_pairs

    rows = log(spark, sf_dir)
    pairs = next_boundary_pairs(rows, "tid", "r", F.col("etype") == "signup", F.col("etype") == "purchase")
    at = rows.select("tid", F.col("r").alias("entry"), "k", F.col("ns").alias("entry_ns"))
    ends = rows.select("tid", F.col("r").alias("ending"), F.col("ns").alias("ending_ns"))
    return pairs.join(at, ["tid", "entry"]).join(ends, ["tid", "ending"], "left").select("tid", "entry", "ending", "state", F.pmod("k", F.lit(16)).alias("address"), "entry_ns", "ending_ns")
