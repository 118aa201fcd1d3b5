"""Event filters: values within a field are alternatives, fields must all hold, an empty field asks nothing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import ascii_lower
from tracelake.functions.u64 import checked_add, u64_key, u64_literal
from tracelake.schema import Trace

MAX_TERMS, MAX_TEXT, MAX_PAIRS = 512, 1 << 20, 4096
DIRECTIONS = ("read", "write", "read_write", "unknown")
SEMANTIC_KINDS = ("semantic_call", "semantic_rule", "semantic_error")


class FilterError(ValueError):
    """A filter that can't be run; ``code`` is stable."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class EventFilter:
    """``sequences`` are inclusive pairs; pc ranges are half-open; ``memory`` has (start, end, directions)."""

    tids: tuple[int, ...] = ()
    kinds: tuple[str, ...] = ()
    modules: tuple[int, ...] = ()
    relative_pc: tuple[tuple[int, int], ...] = ()
    absolute_pc: tuple[tuple[int, int], ...] = ()
    sequences: tuple[tuple[int, int], ...] = ()
    mnemonic_exact: tuple[str, ...] = ()
    mnemonic_contains: tuple[str, ...] = ()
    register_reads: tuple[int, ...] = ()
    register_writes: tuple[int, ...] = ()
    memory: tuple[tuple[int, int, tuple[str, ...]], ...] = ()
    categories: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    detail_contains: tuple[str, ...] = ()


def _merge(ranges: tuple[tuple[int, int], ...], inclusive: bool) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if hi < lo or (hi == lo and not inclusive):
            raise FilterError("empty_range", f"range {lo}..{hi} is empty")
        if out and lo <= out[-1][1] + inclusive:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def _texts(values: tuple[str, ...], fold: bool) -> tuple[str, ...]:
    done = [v.strip() if fold else v for v in values]
    if any(not v for v in done):
        raise FilterError("empty_text", "a text pattern is empty")
    lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v) for v in done] if fold else done
    return tuple(sorted(set(lowered)))


def _merge_memory(entries: tuple[tuple[int, int, tuple[str, ...]], ...]) -> tuple[tuple[int, int, tuple[str, ...]], ...]:
    """Canonical: ranges merged for each set of directions, so that equal unions are equal filters."""
    by: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for lo, hi, directions in entries:
        if unknown := set(directions) - set(DIRECTIONS):
            raise FilterError("unknown_direction", f"unknown direction {sorted(unknown)}")
        for d in sorted(set(directions)) or [""]:
            by.setdefault(d, []).append((lo, hi))
    merged = {d: _merge(tuple(r), False) for d, r in by.items()}
    # A range that any direction may match makes the same range of one direction redundant only where it covers it.
    cuts = sorted({x for r in merged.values() for pair in r for x in pair})
    out: list[list] = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        held = tuple(sorted(d for d, r in merged.items() if any(a <= lo and hi <= b for a, b in r)))
        if not held:
            continue
        held = () if "" in held else held
        if out and out[-1][1] == lo and out[-1][2] == held:
            out[-1][1] = hi
        else:
            out.append([lo, hi, held])
    return tuple((a, b, d) for a, b, d in out)


def normalized(f: EventFilter) -> EventFilter:
    """The canonical form; raises FilterError for empty texts or ranges and for filters that are too large."""
    done = replace(
        f,
        tids=tuple(sorted(set(f.tids))),
        kinds=tuple(sorted(set(f.kinds))),
        modules=tuple(sorted(set(f.modules))),
        relative_pc=_merge(f.relative_pc, False),
        absolute_pc=_merge(f.absolute_pc, False),
        sequences=_merge(f.sequences, True),
        mnemonic_exact=_texts(f.mnemonic_exact, True),
        mnemonic_contains=_texts(f.mnemonic_contains, True),
        register_reads=tuple(sorted(set(f.register_reads))),
        register_writes=tuple(sorted(set(f.register_writes))),
        memory=_merge_memory(f.memory),
        categories=_texts(f.categories, False),
        names=_texts(f.names, False),
        detail_contains=_texts(f.detail_contains, False),
    )
    values = [v for x in fields(f) for v in getattr(f, x.name)]
    if len(values) > MAX_TERMS:
        raise FilterError("too_many_terms", f"{len(values)} terms; at most {MAX_TERMS}")
    if sum(len(v.encode()) for v in values if isinstance(v, str)) > MAX_TEXT:
        raise FilterError("too_much_text", f"more than {MAX_TEXT} bytes of text")
    if len(done.modules) * len(done.relative_pc) > MAX_PAIRS:
        raise FilterError("too_many_pairs", f"more than {MAX_PAIRS} pairs of module and range")
    return done


def digest(f: EventFilter) -> str:
    """SHA-256 of the canonical form: equal unions of ranges have equal digests."""
    done = normalized(f)
    return hashlib.sha256(json.dumps({x.name: getattr(done, x.name) for x in fields(done)}, sort_keys=True).encode()).hexdigest()


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _within(c: Column, ranges: tuple[tuple[int, int], ...], inclusive: bool = False) -> Column:
    key = u64_key(c)
    tests = []
    for lo, hi in ranges:
        at_least = key >= u64_key(u64_literal(lo))
        tests.append(at_least & ((key <= u64_key(u64_literal(hi))) if inclusive else (key < u64_key(u64_literal(hi))) if hi < 2**64 else at_least))
    return _any(tests)


def direction_matches(actual: Column, wanted: tuple[str, ...]) -> Column:
    """A read-write access is also a read and a write; asking for read-write or unknown asks for just that."""
    if not wanted:
        return F.lit(True)
    accepted = set(wanted) | ({"read_write"} if {"read", "write"} & set(wanted) else set())
    return _sure(actual.isin(*sorted(accepted)))


def overlaps(start: Column, end: Column, lo: int, hi: int) -> Column:
    """Half-open overlap; accesses of no size never match.  A null end stands for 2**64."""
    below = (u64_key(start) < u64_key(u64_literal(hi))) if hi < 2**64 else F.lit(True)
    return _sure(below) & (end.isNull() | _sure(u64_key(u64_literal(lo)) < u64_key(end))) & ~_sure(start == end)


def apply_filter(trace: Trace, wanted: EventFilter) -> DataFrame:
    """The events that a filter lets through, with the columns of ``events``.

    Conditions on events alone become one predicate, which reaches the scan.  Each
    side table is asked through one semi-join on (artifact, row).
    """
    f = normalized(wanted)
    events = trace.events
    tests: list[Column] = []
    if f.tids:
        tests.append(_sure(F.col("tid").isin(*f.tids)))
    if f.kinds:
        tests.append(_sure(F.col("kind").isin(*f.kinds)))
    if f.sequences:
        tests.append(_sure(_within(F.col("sequence"), f.sequences, True)))
    if f.detail_contains:
        tests.append(_sure(F.col("kind").isin(*SEMANTIC_KINDS)))
    for t in tests:
        events = events.where(t)

    def keep(rows: DataFrame) -> None:
        nonlocal events
        owners = rows.select("artifact", F.col("owner_row").alias("source_row"))
        events = events.join(owners, ["artifact", "source_row"], "left_semi")

    if f.modules or f.relative_pc or f.absolute_pc:
        keep(_at_position(trace, f))
    if f.mnemonic_exact or f.mnemonic_contains:
        said = ascii_lower(F.col("mnemonic"))
        if f.mnemonic_exact:
            known = _any([said.isin(*f.mnemonic_exact)] + [said.contains(p) for p in f.mnemonic_contains])
        else:
            known = _any([said.contains(p) for p in f.mnemonic_contains])
        keep(trace.instructions.join(trace.definitions.where(_sure(known)).select("artifact", "definition"), ["artifact", "definition"], "left_semi"))
    for slots, access in ((f.register_reads, "read"), (f.register_writes, "write")):
        if slots:
            keep(trace.register_obs.where((F.col("access") == access) & F.col("slot").isin(*slots)))
    if f.memory:
        keep(trace.memory.where(_any([overlaps(F.col("address"), F.col("end_exclusive"), a, b) & direction_matches(F.col("direction"), d) for a, b, d in f.memory])))
    if f.categories or f.names or f.detail_contains:
        rows = trace.semantics
        for values, column in ((f.categories, "category"), (f.names, "name")):
            if values:
                rows = rows.where(_sure(F.col(column).isin(*values)))
        if f.detail_contains:
            rows = rows.where(_any([_sure(F.col("detail").contains(p)) for p in f.detail_contains]))
        keep(rows)
    return events


def positions(trace: Trace) -> DataFrame:
    """(artifact, owner_row, module, relative_pc): an instruction's place, else its memory access's."""
    first = trace.instructions.select("artifact", "owner_row", "module", "relative_pc")
    if trace.memory is None:
        return first
    rest = trace.memory.select("artifact", "owner_row", "module", "relative_pc").join(first.select("artifact", "owner_row"), ["artifact", "owner_row"], "left_anti")
    return first.unionByName(rest)


def _at_position(trace: Trace, f: EventFilter) -> DataFrame:
    at = positions(trace)
    if f.modules:
        at = at.where(_sure(F.col("module").isin(*f.modules)))
    if f.relative_pc:
        at = at.where(_sure(_within(F.col("relative_pc"), f.relative_pc)))
    if f.absolute_pc:
        # A sum past 64 bits is null and matches nothing.  The module table is a dictionary: AQE decides how to join it.
        at = at.join(trace.modules.select("artifact", "module", "base"), ["artifact", "module"])
        at = at.where(_sure(_within(checked_add(F.col("base"), F.col("relative_pc")), f.absolute_pc)))
    return at
