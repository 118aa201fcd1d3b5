"""The session interface: workspaces of traces with projections, pages, states, trees, symbols and annotations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import calltree, intervals, memory, metrics, registers, timeline
from tracelake.operators.annotations import ANNOTATIONS, EVENT, HIGHLIGHTS, LOCAL_NAMES, SideTable
from tracelake.operators.filters import EventFilter, apply_filter, digest, normalized
from tracelake.schema import Trace
from tracelake.sources.sidecars import open_session
from tracelake.sources.trace_stream import TraceStreamSource, normalize
from tracelake.streaming.incremental import cancel_job, run_job

#: Budgets of interactive calls.
PAGE_ROWS, TREE_PAGE, KEPT_JOBS = 2000, 100, 64


#: Artifacts of a session and failures among them; more are an error and never left out.
MAX_ARTIFACTS, MAX_FAILURES = 10_000, 1_000


def _bounded(rows: DataFrame, most: int, what: str) -> list[Row]:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} {what}")
    return found


@dataclass
class _Workspace:
    trace: Trace
    store: str
    warnings: list[str] = field(default_factory=list)
    projections: dict[str, tuple[EventFilter, DataFrame]] = field(default_factory=dict)
    symbols: DataFrame | None = None
    trees: dict[tuple, DataFrame] = field(default_factory=dict)


class TraceService:
    """Every method takes the workspace that ``open_*`` returned; results are small and bounded, or DataFrames."""

    def __init__(self, spark: SparkSession, side_path: str) -> None:
        self._spark, self._side = spark, side_path.rstrip("/")
        self._open: dict[str, _Workspace] = {}
        self._jobs: dict[str, str] = {}
        spark.dataSource.register(TraceStreamSource)

    # Opening.
    def open_trace(self, trace: Trace, identity: str, warnings: list[str] | None = None) -> str:
        name = uuid.uuid4().hex
        self._open[name] = _Workspace(trace, identity, warnings or [])
        return name

    def open_artifact(self, path: str, partial: bool = False) -> str:
        records = self._spark.read.format("trace_stream").option("partial", str(partial)).option("tolerant", "true").load(path)
        records = records.persist()
        failed = _bounded(records.where("kind = 'failure'").select("artifact", "failure"), MAX_FAILURES, "failed artifacts")
        failures = [f"{r['artifact']}: {r['failure']}" for r in failed]
        content = metrics.content_identity(1, "trace_stream", records.count(), path)
        return self.open_trace(normalize(records), metrics.store_identity(content, "v1"), failures)

    def open_session(self, report: str) -> str:
        rows = _bounded(open_session(self._spark, report), MAX_ARTIFACTS, "artifacts in a report")
        good = [r["path"] for r in rows if r["usable"] and r["format"] == "stream"]
        warnings = [f"{r['name']}: {r['warning']}" for r in rows if not r["usable"]]
        if not good:
            raise ValueError("the session has no usable artifact")
        records = self._spark.read.format("trace_stream").option("tolerant", "true")
        tables = [records.load(p) for p in good]
        merged = tables[0]
        for t in tables[1:]:
            merged = merged.unionByName(t)
        return self.open_trace(normalize(merged), metrics.store_identity("|".join(good), "v1"), warnings)

    def close_workspace(self, workspace: str) -> None:
        self._open.pop(workspace)

    def workspace_summary(self, workspace: str) -> dict[str, Any]:
        w = self._open[workspace]
        kinds = {r["kind"]: r["n"] for r in w.trace.events.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # one row for each of the kinds
        return {"store": w.store, "kinds": kinds, "warnings": w.warnings, "projections": len(w.projections)}

    # Timelines.
    def create_projection(self, workspace: str, wanted: EventFilter) -> str:
        w = self._open[workspace]
        name = digest(wanted) + w.store[:8]
        w.projections[name] = (normalized(wanted), apply_filter(w.trace, wanted))
        return name

    def query_timeline(self, workspace: str, projection: str, limit: int, cursor: str | None = None) -> timeline.Page:
        w = self._open[workspace]
        wanted, rows = w.projections[projection]
        return timeline.query_page(rows, w.store, wanted, limit, cursor)

    def locate_timeline(self, workspace: str, projection: str, source_row: int, limit: int) -> Row | None:
        found = timeline.locate(self._open[workspace].projections[projection][1], source_row, limit).collect()
        return found[0] if found else None

    def locate_timeline_offset(self, workspace: str, projection: str, offset: int, limit: int) -> list[Row]:
        return timeline.page_at(self._open[workspace].projections[projection][1], offset, min(limit, PAGE_ROWS)).collect()

    def get_event_detail(self, workspace: str, source_row: int) -> Row | None:
        return timeline.event_detail(self._open[workspace].trace, source_row).first()

    # States.
    def _target(self, workspace: str, source_row: int) -> DataFrame:
        return self._open[workspace].trace.events.where(F.col("source_row") == source_row).select("artifact", "timeline", "tid", F.col("source_row").alias("row"))

    def get_register_state(self, workspace: str, source_row: int) -> DataFrame:
        t = self._open[workspace].trace
        broken = registers.invalidations(t.discontinuities, t.register_obs)
        kinds = ("instruction", "register_checkpoint", "register_delta", "discontinuity")
        replay = t.events.where(F.col("kind").isin(*kinds)).select("artifact", "timeline", "tid", F.col("source_row").alias("row"))
        return registers.states_at(self._target(workspace, source_row), t.register_obs, broken, replay)

    def _range(self, workspace: str, source_row: int, lo: int, hi: int) -> DataFrame:
        if hi < lo or hi - lo > memory.MAX_RANGE:
            raise ValueError("reversed range or range over 1 MiB")
        return self._target(workspace, source_row).select("*", F.lit(0).alias("target"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))

    def get_memory_state(self, workspace: str, source_row: int, lo: int, hi: int) -> DataFrame:
        t = self._open[workspace].trace
        return memory.state_at(self._range(workspace, source_row, lo, hi), t.memory, t.discontinuities, t.global_ordering)

    def get_memory_history(self, workspace: str, source_row: int, lo: int, hi: int) -> DataFrame:
        return memory.history(self._range(workspace, source_row, lo, hi), self._open[workspace].trace.memory).orderBy("row")

    def get_call_tree(self, workspace: str, rows: DataFrame, parent: int | None = None, offset: int = 0) -> list[Row]:
        w = self._open[workspace]
        key = ("tree",)
        if key not in w.trees:
            w.trees[key] = calltree.build(rows).persist()
        return calltree.children_page(w.trees[key], parent, offset, TREE_PAGE).collect()

    # Symbols.
    def attach_elf(self, workspace: str, symbols: DataFrame) -> None:
        """``symbols``: module, address, size, name, precedence."""
        self._open[workspace].symbols = intervals.dedupe_symbols(symbols, ["module"])

    def list_symbols(self, workspace: str, limit: int = PAGE_ROWS) -> list[Row]:
        found = self._open[workspace].symbols
        return [] if found is None else found.orderBy("module", "address").limit(min(limit, PAGE_ROWS)).collect()

    def symbolize(self, workspace: str, pcs: DataFrame) -> DataFrame:
        resolved = intervals.resolve_symbols(pcs, self._open[workspace].symbols, ["module"])
        return intervals.local_names(resolved, self._names().read(), ["module"])

    # Notes.
    def _notes(self, what: str) -> SideTable:
        return SideTable(self._spark, f"{self._side}/{what}", ANNOTATIONS if what == "annotations" else HIGHLIGHTS, EVENT)

    def _names(self) -> SideTable:
        return SideTable(self._spark, f"{self._side}/local_names", LOCAL_NAMES, ("module", "address"))

    def get_annotation(self, keys: DataFrame) -> DataFrame:
        return self._notes("annotations").get(keys)

    def upsert_annotation(self, rows: DataFrame) -> None:
        self._notes("annotations").upsert(rows)

    def delete_annotation(self, keys: DataFrame) -> None:
        self._notes("annotations").delete(keys)

    def upsert_highlight(self, rows: DataFrame) -> None:
        self._notes("highlights").upsert(rows)

    def delete_highlight(self, keys: DataFrame) -> None:
        self._notes("highlights").delete(keys)

    def get_local_symbol_name(self, keys: DataFrame) -> DataFrame:
        return self._names().get(keys)

    def upsert_local_symbol_name(self, rows: DataFrame) -> None:
        self._names().upsert(rows)

    def delete_local_symbol_name(self, keys: DataFrame) -> None:
        self._names().delete(keys)

    # Jobs.
    def run(self, job: str, work: Callable[[], Any]) -> Any:
        self._jobs[job] = "running"
        try:
            result = run_job(self._spark, job, work)
        except Exception:
            self._jobs[job] = "failed"
            raise
        self._jobs[job] = "complete"
        for old in [j for j, s in self._jobs.items() if s != "running"][:-KEPT_JOBS]:
            del self._jobs[old]
        return result

    def list_jobs(self) -> dict[str, str]:
        return dict(self._jobs)

    def cancel_job(self, job: str) -> None:
        cancel_job(self._spark, job)
        self._jobs[job] = "cancelled"


class RuleSet:
    """User rules over instruction rows, in order: each a name and a Column predicate or a pandas UDF column."""

    def __init__(self) -> None:
        self._rules: list[tuple[str, Any]] = []

    def add(self, name: str, matches: Any) -> RuleSet:
        self._rules.append((name, matches))
        return self

    def at_offset(self, name: str, module: int, offset: int) -> RuleSet:
        return self.add(name, (F.col("module") == module) & (F.col("relative_pc") == offset))

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``rules``: the names of the rules that match, in order."""
        hits = [F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in self._rules]
        return rows.withColumn("rules", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))


#: Column subsets of the capture profiles.
PROFILES = {
    "fast": ("events", "modules", "definitions", "instructions", "semantics", "register_obs"),
    "balanced": ("events", "modules", "definitions", "instructions", "semantics", "register_obs", "memory"),
    "full": ("events", "modules", "definitions", "instructions", "semantics", "register_obs", "memory"),
}


def profile_tables(trace: Trace, profile: str) -> dict[str, DataFrame]:
    """The tables of a profile; balanced drops captured bytes."""
    tables = {n: getattr(trace, n) for n in PROFILES[profile]}
    if profile == "balanced":
        tables["memory"] = tables["memory"].drop("before", "after")
    return tables
