import pytest
from pyspark.sql import functions as F
from tracelake import schema
from tracelake.operators.annotations import ANNOTATIONS, EVENT, LOCAL_NAMES, SideTable
from tracelake.operators.filters import EventFilter
from tracelake.plans import views
from tracelake.plans.service import RuleSet, TraceService, profile_tables
from tracelake.sources import wire
from tracelake.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_partial_scan_equals_batch(spark, tmp_path):
    events = views.trace(spark, SF).events
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(4).write.parquet(src)
    stream = incremental.stream_events(spark, src, schema.EVENTS, 1).where("kind = 'memory'")
    q = incremental.partial_scan(stream, out, str(tmp_path / "ck"))
    q.awaitTermination()
    rows, key, exact = incremental.partial_page(spark, out, 10, q)
    want = events.where("kind = 'memory'").orderBy("source_row")
    assert [r["source_row"] for r in rows] == [r["source_row"] for r in want.limit(10).collect()]
    assert exact and key["record_ordinal"] == want.agg(F.max("source_row")).first()[0]
    state = incremental.progress(q)
    assert state["state"] == "complete" and state["batches"] >= 4 and state["rows"] == events.count()
    again = incremental.partial_scan(stream, out, str(tmp_path / "ck"))  # nothing new, nothing twice
    again.awaitTermination()
    assert spark.read.parquet(out).count() == want.count()


BOUNDARY = "tid long, id long, seq long, phase string, address long, ts timestamp"


def boundaries(spark, path, *files):
    import datetime

    for rows in files:
        data = [(*r, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=r[2])) for r in rows]
        spark.createDataFrame(data, BOUNDARY).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(BOUNDARY).option("maxFilesPerTrigger", 1).parquet(path)


FILES = ([(1, 1, 1, "enter", 9), (2, 1, 2, "enter", 9), (1, 2, 3, "enter", 9)], [(1, 1, 4, "return", 9), (2, 1, 5, "capture_stopped", 9)], [(1, 2, 6, "return", 8), (1, 7, 7, "return", 9)])


def test_stateful_pairs(spark, tmp_path):
    stream = boundaries(spark, str(tmp_path / "in"), *FILES)
    q = incremental.pair_stream(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["tid"], r["id"]): (r["entry"], r["ending"], r["state"]) for r in spark.table("pairs").collect()}
    assert got == {(1, 1): (1, 4, "returned"), (2, 1): (2, 5, "capture_stopped"), (1, 2): (3, 6, "invalid"), (1, 7): (None, 7, "orphan")}


def test_joined_pairs(spark, tmp_path):
    stream = boundaries(spark, str(tmp_path / "in"), *FILES)
    q = incremental.pair_stream_by_join(stream).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["tid"], r["id"]): r["state"] for r in spark.table("joined").collect()} == {(1, 1): "returned", (2, 1): "capture_stopped", (1, 2): "invalid"}


def test_windows(spark, tmp_path):
    stream = boundaries(spark, str(tmp_path / "in"), *FILES).withColumnRenamed("phase", "kind")
    q = incremental.windowed_counts(stream, "4 seconds", late="0 seconds").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 7


def test_side_table(spark, tmp_path):
    notes = SideTable(spark, str(tmp_path / "notes"), ANNOTATIONS, EVENT)
    row = lambda n, text, tid=None: ("a", 0, n, n, None, tid, text, 0)
    assert notes.read().count() == 0
    notes.upsert(spark.createDataFrame([row(1, "one"), row(2, "two")], ANNOTATIONS))
    notes.upsert(spark.createDataFrame([row(2, "new"), row(3, "three", 7)], ANNOTATIONS))
    assert {r["record_ordinal"]: (r["text"], r["revision"]) for r in notes.read().collect()} == {1: ("one", 0), 2: ("new", 1), 3: ("three", 0)}
    keys = notes.read().where("record_ordinal = 2").select(*EVENT)
    assert notes.get(keys).first()["text"] == "new"
    notes.delete(keys)
    assert sorted(r["record_ordinal"] for r in notes.read().collect()) == [1, 3]


def test_service(spark, tmp_path):
    body = wire.header() + wire.encode_begin() + wire.encode_module(0, 0x1000, "lib.so") + wire.encode_definition(1, "BL", {0: (8, "x0")}, {}, flags=4)
    body += wire.encode_instruction(1, 0, 16, 1, [5], [])
    body += wire.encode_access(0, 16, 2, 100, 2, 7, after=(1, b"ab")) + wire.encode_event(6, ["libc", "open"], "x") + wire.encode_stop()
    (tmp_path / "run.trace.bin").write_bytes(body)
    (tmp_path / "bad.trace.bin").write_bytes(b"?")
    s = TraceService(spark, str(tmp_path / "side"))
    w = s.open_artifact(str(tmp_path / "*.bin").replace("/*.bin", ""))
    summary = s.workspace_summary(w)
    assert summary["kinds"]["instruction"] == 1 and len(summary["warnings"]) == 1
    p = s.create_projection(w, EventFilter(kinds=("instruction", "memory")))
    page = s.query_timeline(w, p, 1)
    assert page.total == 2 and page.next is not None and s.query_timeline(w, p, 1, page.next).next is None
    row = page.rows[0]["source_row"]
    assert s.locate_timeline(w, p, row + 1, 1)["page_start"] == 1
    assert s.get_event_detail(w, row)["relative_pc"] == "0x10"
    assert len(s.locate_timeline_offset(w, p, 1, 10)) == 2
    regs = {r["slot"]: r["value"] for r in s.get_register_state(w, row).where("side = 'after'").collect()}
    assert regs[0] == 5 and regs[1] is None
    cells = {r["address"]: r["after"]["value"] for r in s.get_memory_state(w, row + 1, 100, 103).collect()}
    assert cells == {100: ord("a"), 101: ord("b"), 102: None}
    assert s.get_memory_history(w, row + 1, 0, 200).count() == 1
    with pytest.raises(ValueError, match="1 MiB"):
        s.get_memory_state(w, row, 0, 1 << 21)
    s.attach_elf(w, spark.createDataFrame([("m", 16, 4, "f", 1), ("m", 16, 4, "g", 0)], "module string, address long, size long, name string, precedence int"))
    assert [r["name"] for r in s.list_symbols(w)] == ["g"]
    s.upsert_local_symbol_name(spark.createDataFrame([("m", 16, "mine", 0)], LOCAL_NAMES))
    assert s.symbolize(w, spark.createDataFrame([("m", 18)], "module string, pc long")).first()["display_name"] == "mine"
    s.delete_local_symbol_name(spark.createDataFrame([("m", 16)], "module string, address long"))
    assert s.symbolize(w, spark.createDataFrame([("m", 18)], "module string, pc long")).first()["display_name"] == "g"
    tree = s.get_call_tree(w, views.steps(spark, SF))
    assert 0 < len(tree) <= 100
    assert s.run("count", lambda: spark.range(3).count()) == 3 and s.list_jobs()["count"] == "complete"
    rules = RuleSet().add("calls", F.col("kind") == "semantic_call").add("all", F.lit(True))
    assert {tuple(r["rules"]) for r in rules.apply(s._open[w].trace.events).collect()} == {("all",), ("calls", "all")}
    assert "before" not in profile_tables(s._open[w].trace, "balanced")["memory"].columns
    s.close_workspace(w)
    with pytest.raises(KeyError):
        s.workspace_summary(w)
