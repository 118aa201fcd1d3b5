"""Call trees: next pcs by window, frames by a stack machine for each thread."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.u64 import page_base, u64_key, wrapping_add
from tracelake.operators.intervals import carry_rows, running_sum
from tracelake.plans.session import ship

BRANCH, CALL, RETURN = 1, 4, 8  # fixed flag bits
BARRIERS = ("discontinuity", "coverage_gap", "termination", "signal_handler_boundary")
MAX_NODES = 2_000_000  # also of intervals
LINK_REGISTER = 30
SCOPE = ("artifact", "timeline", "tid")
_MASK = 2**64 - 1


def is_call(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(CALL)) != 0


def is_return(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(RETURN)) != 0


def is_barrier(kind: Column) -> Column:
    return kind.isin(*BARRIERS)


def with_thread_barriers(rows: DataFrame) -> DataFrame:
    """Barrier rows without a thread, repeated for every thread of their timeline."""
    threads = rows.where("tid IS NOT NULL").select(*SCOPE).distinct()
    shared = rows.where(F.col("tid").isNull() & F.col("kind").isin("discontinuity", "termination")).drop("tid")
    spread = shared.join(threads, ["artifact", "timeline"]).select(*rows.columns)
    return rows.where("tid IS NOT NULL").unionByName(spread)


def next_pcs(rows: DataFrame) -> DataFrame:
    """``rows`` (scope, row, kind, pc) with ``next_pc``: the thread's next instruction unless a barrier lies between."""
    barrier = is_barrier(F.col("kind"))
    mark = F.when(barrier | (F.col("kind") == "instruction"), F.struct(barrier.alias("barrier"), F.col("pc").alias("pc")))
    ahead = carry_rows(rows, SCOPE, "row", {"__next": mark}, back=True, strict=True)
    return ahead.withColumn("next_pc", F.when((F.col("kind") == "instruction") & ~F.col("__next.barrier"), F.col("__next.pc"))).drop("__next")


def immediate_target(pc: Column, displacement: Column, pc_kind: Column) -> Column:
    """pc (or its page) plus displacement; null where that leaves 64 bits or the instruction is not pc-relative."""
    base = F.when(pc_kind == 1, pc).when(pc_kind == 2, page_base(pc))
    to = wrapping_add(base, displacement)
    inside = F.when(displacement >= 0, u64_key(to) >= u64_key(base)).otherwise(u64_key(to) < u64_key(base))
    return F.when(inside, to)


def depth(rows: DataFrame) -> DataFrame:
    """``rows`` with ``depth``: calls less returns so far; the tree's depth on balanced threads."""
    step = F.when(is_call(F.col("flags")), 1).when(is_return(F.col("flags")), -1).otherwise(0)
    return running_sum(rows, SCOPE, "row", step, "depth")


OUTPUT = (
    "artifact string, timeline bigint, tid bigint, item string, id bigint, parent bigint, start_row bigint, end_row bigint, call_pc bigint, "
    "target bigint, target_evidence string, closed string, provenance string, semantic string"
)


class _Machine:
    """The frames of one thread: nodes, intervals, and the frames that are open."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.extras: list[dict] = []
        self.stack: list[dict] = []

    def push(self, r: dict, target: int | None, evidence: str, back: int | None, parent: int | None, provenance: str) -> None:
        if len(self.nodes) >= MAX_NODES:
            raise ValueError("too many call nodes in one thread")
        node = {
            "item": "node", "id": len(self.nodes), "parent": parent, "start_row": r["row"], "end_row": r["row"], "call_pc": r["pc"] & _MASK, "target": target,
            "target_evidence": evidence, "closed": "source_end", "provenance": provenance, "semantic": None, "back": back,
        }
        self.nodes.append(node)
        self.stack.append(node)

    def pop(self, row: int, how: str, provenance: str | None = None) -> dict:
        """Close the top frame; without a provenance it keeps its own."""
        node = self.stack.pop()
        node.update(end_row=row, closed=how, provenance=provenance or node["provenance"])
        return node

    def pop_all(self, row: int, how: str, provenance: str | None = None) -> None:
        while self.stack:
            self.pop(row, how, provenance)

    def interval(self, kind: str, r: dict, how: str | None, semantic: str | None = None) -> dict:
        if len(self.extras) >= MAX_NODES:
            raise ValueError("too many intervals in one thread")
        made = {
            "item": kind, "id": len(self.extras), "parent": None, "start_row": r["row"], "end_row": r["row"], "call_pc": None, "target": None,
            "target_evidence": None, "closed": how, "provenance": r.get("provenance") or "captured", "semantic": semantic,
        }
        self.extras.append(made)
        return made


def _pick_target(r: dict, following: int | None) -> tuple[int | None, str]:
    """The best evidence of a call's target: immediate, next pc, a read register, the link register."""
    if r["immediate"] is not None:
        return r["immediate"] & _MASK, "immediate"
    if following is not None:
        return following, "next_pc"
    reads = [(x["slot"], x["value"]) for x in r["reads"] or []]
    for slot, value in reads:
        if slot != LINK_REGISTER:
            return value & _MASK, "register"
    if reads:
        return reads[0][1] & _MASK, "link_register"
    return None, "unknown"


def replay(rows: Iterable[dict], infer_tail_calls: bool = True) -> list[dict]:
    """Frames, intervals and lone semantic calls of one thread's rows, in row order.

    Rows say themselves whether they directly follow a call (``after_call``) and whether they begin
    the trace outside of any call (``opens``), so rows that change nothing may be left out.
    """
    m = _Machine()
    signal: dict | None = None
    prefix: dict | None = None
    row = -1

    def end(interval: dict, how: str) -> None:
        interval.update(end_row=row, closed=how)

    for r in rows:
        row, kind, own = r["row"], r["kind"], r.get("provenance") or "captured"
        if kind == "instruction":
            pc = r["pc"] & _MASK
            following = None if r["next_pc"] is None else r["next_pc"] & _MASK
            flags = r["flags"] or 0
            if flags & CALL:
                if prefix is not None:
                    end(prefix, "source_begin")
                    prefix = None
                target, evidence = _pick_target(r, following)
                m.push(r, target, evidence, pc + 4 if pc + 4 <= _MASK else None, m.stack[-1]["id"] if m.stack else None, own)
            elif flags & RETURN:
                if not m.stack:
                    m.interval("unmatched_return", r, "unmatched_return")
                    continue
                fits = [i for i, frame in enumerate(m.stack) if following is not None and frame["back"] == following]
                while fits and len(m.stack) > fits[-1] + 1:
                    m.pop(row, "unwind", "heuristic")
                    m.interval("unwind", r, "unwind")
                m.pop(row, "complete")
            elif flags & BRANCH and infer_tail_calls and m.stack:
                target = None if r["immediate"] is None else r["immediate"] & _MASK
                if target is not None and target == following and target != min(pc + 4, _MASK):
                    left = m.pop(row, "tail_call", "heuristic")
                    m.push(r, target, "immediate", None, left["parent"], "heuristic")
            elif r.get("opens"):
                prefix = m.interval("trace_boundary", r, "source_begin")
        elif kind == "semantic_call":
            said = "/".join(str(x) for x in (r["category"], r["name"]) if x is not None)
            if r.get("after_call"):
                m.nodes[-1]["semantic"] = said
            else:
                m.interval("semantic", r, None, said)
        elif kind == "signal_handler_boundary":
            if r.get("phase") == "begin":
                m.pop_all(row, "signal_transition")
                if signal is not None:
                    end(signal, "signal_transition")
                signal = m.interval("signal_handler", r, "signal_transition")
            elif signal is not None:
                end(signal, "complete")
                signal = None
            else:
                m.interval("signal_handler", r, "signal_transition")
        elif kind in ("discontinuity", "coverage_gap"):
            m.pop_all(row, "discontinuity", "damaged")
            if signal is not None:
                end(signal, "discontinuity")
                signal = None
            prefix = None
        elif kind == "termination":
            m.pop_all(row, "termination")
            prefix = None
    m.pop_all(row, "source_end")
    if signal is not None:
        end(signal, "source_end")
    if prefix is not None:
        end(prefix, "source_begin")
    return m.nodes + m.extras


def build(rows: DataFrame, infer_tail_calls: bool = True) -> DataFrame:
    """Call nodes, intervals and lone semantic calls of every thread of ``rows``.

    ``rows``: scope, row, kind, pc, flags, displacement, pc_kind, reads, category, name, and if there
    are such, provenance and the phase of signal handler boundaries.  Frames depend on order, so a
    thread is one group; a thread of over ``MAX_NODES`` calls is an error, as it is by the
    semantics.  Only rows that change the frames go into a group, and the thread's last one.
    """
    ship(rows.sparkSession)
    given = {c: F.lit(v).cast("string") for c, v in (("provenance", "captured"), ("phase", None)) if c not in rows.columns}
    ready = next_pcs(with_thread_barriers(rows.withColumns(given))).withColumn("immediate", immediate_target(F.col("pc"), F.col("displacement"), F.col("pc_kind")))
    code, flags = F.col("kind") == "instruction", F.coalesce("flags", F.lit(0))
    thread = Window.partitionBy(*SCOPE)
    first = F.min(F.when(code | is_barrier(F.col("kind")), F.col("row"))).over(thread)
    called = F.lag(code & is_call(flags)).over(thread.orderBy("row"))
    marked = ready.withColumns({
        "after_call": F.coalesce(called, F.lit(False)) & (F.col("kind") == "semantic_call"),
        "opens": code & ~is_call(flags) & ~is_return(flags) & (F.col("row") == first),
        "__last": F.col("row") == F.max("row").over(thread),
    })
    flagged = code & (flags.bitwiseAND(F.lit(BRANCH | CALL | RETURN)) != 0)
    kept = marked.where(flagged | (F.col("kind") == "semantic_call") | is_barrier(F.col("kind")) | F.col("opens") | F.col("__last"))
    kept = kept.select(*SCOPE, "row", "kind", "pc", "flags", "next_pc", "immediate", "reads", "category", "name", "provenance", "phase", "after_call", "opens")

    names = [c.split()[0] for c in OUTPUT.split(", ")]
    target = rows.sparkSession.createDataFrame([], OUTPUT).schema

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # Arrow and not pandas: a null must not turn 64-bit values into floats.
        from pyspark.sql.pandas.types import to_arrow_schema

        found = replay(table.sort_by("row").to_pylist(), infer_tail_calls)
        scope = dict(zip(SCOPE, (k.as_py() for k in key), strict=True))
        for f in found:
            f.update(scope)
            for c in ("call_pc", "target"):
                if f[c] is not None and f[c] >= 2**63:
                    f[c] -= 2**64
        out = to_arrow_schema(target)
        return pa.Table.from_arrays([pa.array([f[n] for f in found], type=out.field(n).type) for n in names], schema=out)

    return kept.groupBy(*SCOPE).applyInArrow(run, target)


def children_page(tree: DataFrame, parent: int | None, offset: int = 0, limit: int = 100) -> DataFrame:
    """The children of a node (of the root for None) by id, a page at a time."""
    wanted = F.col("parent").isNull() if parent is None else F.col("parent") == parent
    return tree.where((F.col("item") == "node") & wanted).orderBy("id").offset(offset).limit(limit)


def tree_identity(store: str, timeline: int, tid: int | None, infer_tail_calls: bool = True, names: dict[int, str] | None = None) -> str:
    """The identity of a tree: of its store, thread and options, display names included."""
    hash_ = hashlib.sha256(f"calltree|2|{store}|{timeline}|{tid}|{infer_tail_calls}|{len(names or {})}".encode())
    for address, name in sorted((names or {}).items()):
        hash_.update(f"|{address}|{len(name.encode())}|{name}".encode())
    return hash_.hexdigest()
