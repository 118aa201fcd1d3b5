"""Tables of a normalized trace and the order of their rows.

Unsigned 64-bit values are bit patterns in long columns.  ``source_row`` is the
dense 0-based place of an event in its artifact; side tables point to it with
``owner_row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.u64 import u64_key

EVENTS = (
    "artifact string, timeline bigint, record_ordinal bigint, source_offset bigint, sequence bigint, tid bigint, "
    "source_row bigint, kind string, provenance string"
)
MODULES = "artifact string, module bigint, base bigint, name string"
DEFINITIONS = (
    "artifact string, definition bigint, opcode bigint, read_mask bigint, write_mask bigint, displacement bigint, flags bigint, "
    "pc_kind int, mnemonic string, operands string, reads array<struct<width:int,name:string>>, writes array<struct<width:int,name:string>>"
)
INSTRUCTIONS = "artifact string, owner_row bigint, module bigint, relative_pc bigint, definition bigint"
CAPTURE = "struct<state:string,bytes:binary>"
MEMORY = (
    "artifact string, owner_row bigint, module bigint, relative_pc bigint, address bigint, end_exclusive bigint, size bigint, "
    f"direction string, metadata_available boolean, flags bigint, value bigint, before {CAPTURE}, after {CAPTURE}"
)
SEMANTICS = "artifact string, owner_row bigint, category string, name string, detail string"
REGISTER_OBS = (
    "artifact string, owner_row bigint, obs_ordinal int, slot int, captured_width int, access string, value bigint, provenance string"
)
COMPLETENESS = "artifact string, domain string, lo bigint, hi bigint, provenance string, cause string"
DISCONTINUITIES = "artifact string, source_row bigint, tid bigint, cause string, domain string, lo bigint, hi bigint"

#: Event kinds, provenances from best to worst, and causes in canonical order.
KINDS = (
    "begin", "module_definition", "instruction_definition", "instruction", "memory", "semantic_call", "semantic_rule", "semantic_error",
    "thread_lifecycle", "syscall", "signal", "signal_handler_boundary", "termination", "register_checkpoint", "register_delta",
    "string_definition", "coverage_gap", "discontinuity", "opaque_optional",
)
PROVENANCES = ("captured", "derived", "heuristic", "unknown", "damaged")
CAUSES = (
    "retained", "active", "rotating", "stale", "unreliable", "incomplete", "lost", "overwritten", "coverage_gap", "checksum",
    "unterminated_thread", "missing_terminal", "truncation", "unknown",
)
KEY = ("artifact", "timeline", "record_ordinal", "source_offset", "sequence", "tid")


def rank_of(c: Column, names: tuple[str, ...]) -> Column:
    """The 0-based place of a name in a fixed list; null for others."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(place > 0, place - 1)


def key_order() -> list[Column]:
    """The total order of event keys: unsigned, an absent value before any other."""
    parts = [F.col("artifact").asc_nulls_first()]
    return parts + [u64_key(F.col(c)).asc_nulls_first() for c in KEY[1:]]


@dataclass(frozen=True)
class Trace:
    """The tables of a trace; side tables may be left out where no operator asks for them."""

    events: DataFrame
    modules: DataFrame | None = None
    definitions: DataFrame | None = None
    instructions: DataFrame | None = None
    memory: DataFrame | None = None
    semantics: DataFrame | None = None
    register_obs: DataFrame | None = None
    discontinuities: DataFrame | None = None
    global_ordering: bool = True
