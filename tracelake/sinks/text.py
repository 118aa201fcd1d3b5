"""Text format 4: one line for each visible event, built as a column, and its writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import json_quote
from tracelake.functions.u64 import checked_add, page_base, u64_hex, u64_key, u64_str, wrapping_add
from tracelake.operators.memory import capture_state
from tracelake.operators.timeline import first_after
from tracelake.sources.wire import COUNTERS

# Fixed values of the format.
EXTENDS = ("none", "uxtw", "sxtw", "lsl", "sxtx")
MODES = ("offset", "preindex", "postindex")
ACCESSES = ("none", "read", "write", "readwrite")


def short_hex(c: Column) -> Column:
    """0x and the unsigned digits without leading zeros."""
    return u64_hex(c)


def _named(names: tuple[str, ...], c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))


def register_name(slot: Column) -> Column:
    """X0 .. X30, SP, NZCV, PC by wire slot; none for 255."""
    return (
        F.when(slot == 255, "none").when(slot <= 30, F.concat(F.lit("X"), slot.cast("string"))).when(slot == 31, "SP").when(slot == 32, "NZCV").when(slot == 33, "PC")
        .otherwise(F.concat(F.lit("R"), slot.cast("string")))
    )


def asm(pc: Column) -> Column:
    """Mnemonic and operands; a pc-relative last operand as its target, modulo 2**64."""
    base = F.when(F.col("pc_kind") == 2, page_base(pc)).otherwise(pc)
    target = short_hex(wrapping_add(base, F.col("displacement")))
    lead = F.when(F.col("operands").contains(","), F.concat(F.regexp_extract("operands", r"(?s)^(.*),[^,]*$", 1), F.lit(", "))).otherwise("")
    plain = F.when(F.col("operands") != "", F.concat_ws(" ", "mnemonic", "operands")).otherwise(F.col("mnemonic"))
    known = F.when(F.col("pc_kind") > 0, F.concat("mnemonic", F.lit(" "), lead, target)).otherwise(plain)
    return F.when(F.col("mnemonic") != "", known).otherwise(F.when(F.col("disassembly") != "", F.col("disassembly")).otherwise("<undecoded>"))


def _registers(defined: str, values: str) -> Column:
    pairs = F.arrays_zip(F.col(defined).alias("d"), F.col(values).alias("v"))
    texts = F.transform(pairs, lambda x: F.concat(x["d"]["name"], F.lit(":"), x["d"]["width"].cast("string"), F.lit("="), short_hex(x["v"])))
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _operands() -> Column:
    def text(o: Column) -> Column:
        return F.concat(
            F.lit("base="), register_name(o["base"]), F.lit(",index="), register_name(o["index"]), F.lit(",extend="), _named(EXTENDS, o["extend"]),
            F.lit(",mode="), _named(MODES, o["address_mode"]), F.lit(",shift="), o["shift"].cast("string"), F.lit(",kind="), _named(ACCESSES, o["access_kind"]),
            F.lit(",writeback="), o["writeback"].cast("string"), F.lit(",size="), o["access_size"].cast("string"), F.lit(",disp="), o["displacement"].cast("string"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform("memory_operands", text), ";"), F.lit("]"))


def _line(word: str, *fields: tuple[str, Column]) -> Column:
    parts = [F.lit(word)] if word else []
    for name, value in fields:
        parts += [F.lit(f" {name}="), value.cast("string")]
    return F.concat(*parts)


def render(records: DataFrame) -> DataFrame:
    """(artifact, record_ordinal, tid, line) of the visible events of decoded stream records."""
    modules = records.where("kind = 'module_definition'").select("artifact", "module", F.col("module_base").alias("base"), F.col("module_name").alias("in_module")).dropDuplicates(["artifact", "module"])
    defined = records.where("kind = 'instruction_definition'").select(
        "artifact", "definition", "opcode", "displacement", "flags", "pc_kind", "condition", "slow_memory_path", "mnemonic", "operands", "disassembly", "reads", "writes", "memory_operands"
    ).dropDuplicates(["artifact", "definition"])
    own = ["artifact", "record_ordinal", "tid", "kind", "sequence", "module", "relative_pc", "definition", "read_values", "write_values", "direction", "metadata_available", "access_flags", "address", "size", "value", "before", "after", "category", "name", "detail", "begin", "terminal"]
    rows = records.where(~F.col("kind").isin("module_definition", "instruction_definition", "opaque_optional", "failure", "truncation")).select(*own)
    rows = rows.join(modules, ["artifact", "module"], "left").join(defined, ["artifact", "definition"], "left")
    pc = wrapping_add(F.col("base"), F.col("relative_pc"))
    place = [("module", json_quote(F.col("in_module"))), ("module_base", short_hex(F.col("base"))), ("pc", short_hex(pc)), ("relative_pc", short_hex(F.col("relative_pc")))]
    number = lambda c: c.cast("int").cast("string")
    instruction = _line(
        "INST", ("seq", u64_str(F.col("sequence"))), *place, ("metadata_id", F.col("definition")), ("opcode", short_hex(F.col("opcode"))), ("asm", json_quote(asm(pc))),
        ("flags", short_hex(F.col("flags"))), ("condition", F.col("condition")), ("reads", _registers("reads", "read_values")), ("writes", _registers("writes", "write_values")),
        ("slow_memory_path", F.col("slow_memory_path")), ("memory_operands", _operands()),
    )
    access = _line(
        "MEMORY", *place, ("kind", F.regexp_replace("direction", "_", "")), ("metadata_available", number(F.col("metadata_available"))), ("flags", short_hex(F.col("access_flags"))),
        ("address", short_hex(F.col("address"))), ("size", F.col("size")), ("value", short_hex(F.col("value"))),
        ("before", capture_state(F.col("before.bytes"), F.col("before.state"))), ("after", capture_state(F.col("after.bytes"), F.col("after.state"))),
    )
    said = [("name", json_quote(F.col("name"))), ("detail", json_quote(F.col("detail")))]
    b = lambda n: F.col(f"begin.{n}")
    begin = _line(
        "TRACE_BEGIN format=4", ("scene", json_quote(b("scene"))), ("target", json_quote(b("target"))), ("target_offset", short_hex(b("target_offset"))), ("base", short_hex(b("module_base"))),
        ("address", short_hex(b("target_address"))), ("pid", b("pid")), ("tid", F.col("tid")), ("profile", b("profile")), ("compression", number(b("compressed"))),
        ("effective_buffer_bytes", u64_str(b("effective_buffer_bytes"))), ("run_id", u64_str(b("run_id"))),
    )
    counters = [(c, u64_str(F.col(f"terminal.{c}"))) for c in COUNTERS]
    completed = _line("TRACE_END status=completed return_valid=1", ("return", short_hex(F.col("terminal.return_value"))), *counters)
    stopped = _line("TRACE_END status=stopped", ("reason", F.col("terminal.reason")), ("return_valid", F.lit("0")), *counters)
    line = (
        F.when(F.col("kind") == "instruction", instruction)
        .when(F.col("kind") == "memory", access)
        .when(F.col("kind") == "semantic_call", _line("CALL", ("category", json_quote(F.col("category"))), *said))
        .when(F.col("kind") == "semantic_rule", _line("RULE", *said))
        .when(F.col("kind") == "semantic_error", _line("ERROR", *said))
        .when(F.col("kind") == "begin", begin)
        .when((F.col("kind") == "termination") & (F.col("terminal.status") == "completed"), completed)
        .when(F.col("kind") == "termination", stopped)
    )
    return rows.select("artifact", "record_ordinal", "tid", line.alias("line"))


def write_text(lines: DataFrame, path: str, force: bool = False) -> None:
    """Lines in stored order by artifact; published by the write's commit, never over an existing output unless forced."""
    ordered = lines.repartitionByRange("artifact", "record_ordinal").sortWithinPartitions("artifact", "record_ordinal")
    ordered.select("artifact", "line").write.mode("overwrite" if force else "errorifexists").partitionBy("artifact").text(path)


def write_by_thread(lines: DataFrame, path: str, force: bool = False) -> None:
    """One folder of text for each thread, lines in sequence order within it."""
    mode = "overwrite" if force else "errorifexists"
    lines.repartitionByRange("tid", "sequence").sortWithinPartitions("tid", "sequence").select("tid", "line").write.mode(mode).partitionBy("tid").text(path)


def export_range(events: DataFrame, after: int, until: int, max_events: int) -> DataFrame:
    """At most ``max_events`` rows with after < sequence <= until; has_more says if any were left, complete is never true."""
    return first_after(events, max_events, after, until).withColumn("complete", F.lit(False))


def capture_summary(captures: DataFrame, shown: int = 16) -> DataFrame:
    """(line) for people: the first ``shown`` captures by name, then how many more there are."""
    text = F.concat(F.lit("Capture "), "name", F.lit(": "), F.col("returned").cast("string"), F.lit(" returned, "), (F.col("scenes") - F.col("returned")).cast("string"), F.lit(" without proof of a return, "), F.col("missing").cast("string"), F.lit(" missing ranges"))
    first = captures.orderBy("name").limit(shown).select(F.lit(0).alias("part"), "name", text.alias("line"))
    rest = captures.agg((F.count("*") - shown).alias("n")).where("n > 0").select(F.lit(1).alias("part"), F.lit("").alias("name"), F.concat(F.lit("and "), F.col("n").cast("string"), F.lit(" further captures in the report")).alias("line"))
    return first.unionByName(rest).orderBy("part", "name").select("line")
