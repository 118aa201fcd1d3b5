"""Closed forms against plain ordered folds over random logs."""

import random

import pytest
from pyspark.sql import functions as F
from tracelake.operators import calltree, intervals, memory, registers

CAPTURE = "struct<state:string,bytes:binary>"
MEMORY = f"artifact string, timeline long, row long, tid long, address long, end_exclusive long, size long, direction string, metadata_available boolean, value long, before {CAPTURE}, after {CAPTURE}"
DISC = "artifact string, timeline long, row long, tid long, domain string, lo long, hi long"
TARGETS = "artifact string, timeline long, target long, row long, tid long, lo long, hi long"
NONE = ("not_captured", None)


def access(row, tid, address, size, direction, value=0, before=NONE, after=NONE, available=True):
    return ("a", 0, row, tid, address, address + size, size, direction, available, value, before, after)


def cells(spark, target, rows, discs=(), ordered=True):
    got = memory.state_at(spark.createDataFrame([target], TARGETS), spark.createDataFrame(rows, MEMORY), spark.createDataFrame(list(discs), DISC), ordered).collect()
    return {r["address"]: r for r in got}


def test_partial_overlap(spark):
    rows = [access(0, 1, 0x2000, 8, "write", after=("available", bytes(range(1, 9)))), access(1, 1, 0x2002, 4, "read", value=0x09080706, before=("available", b"\x03\x04\x05\x06"))]
    got = cells(spark, ("a", 0, 1, 1, 1, 0x2002, 0x2006), rows)
    assert [got[0x2002 + i]["last_written"]["value"] for i in range(4)] == [3, 4, 5, 6]
    assert {r["last_written"]["provenance"] for r in got.values()} == {"derived"}
    assert [got[0x2002 + i]["observed"]["value"] for i in range(4)] == [6, 7, 8, 9]
    assert [got[0x2002 + i]["before"]["value"] for i in range(4)] == [3, 4, 5, 6]


def test_unavailable_and_conflicting_writes(spark):
    rows = [access(0, 1, 100, 2, "write", after=("unavailable", None)), access(1, 1, 200, 2, "write", after=("available", b"xy")), access(9, 2, 201, 1, "write", after=("available", b"z"))]
    got = cells(spark, ("a", 0, 1, 5, 1, 100, 103), rows)
    assert [got[a]["last_written"]["provenance"] for a in (100, 101, 102)] == ["damaged", "damaged", "unknown"]
    got = cells(spark, ("a", 0, 1, 5, 1, 200, 202), rows, ordered=False)
    assert [got[a]["last_written"]["provenance"] for a in (200, 201)] == ["derived", "damaged"]
    got = cells(spark, ("a", 0, 1, 5, 1, 200, 202), rows)
    assert [got[a]["last_written"]["value"] for a in (200, 201)] == [ord("x"), ord("y")]


def test_ranges(spark):
    assert cells(spark, ("a", 0, 1, 5, 1, 7, 7), [access(0, 1, 7, 1, "write")]) == {}
    for lo, hi, message in ((5, 4, "reversed"), (0, (1 << 20) + 1, "1 MiB")):
        with pytest.raises(Exception, match=message):
            cells(spark, ("a", 0, 1, 5, 1, lo, hi), [access(0, 1, 7, 1, "write")])


@pytest.mark.parametrize("seed", range(4))
def test_memory_against_fold(spark, seed):
    r = random.Random(seed)
    rows, discs = [], []
    for row in range(40):
        if r.random() < 0.25:
            lo = r.randrange(16)
            discs.append(("a", 0, row, r.choice([None, 1, 2]), r.choice(["memory", "sequence"]) if r.random() < 0.5 else "memory", lo, lo + r.randrange(0, 6)))
        else:
            size = r.randrange(0, 6)
            state = r.choice(["available", "available", "unavailable", "not_captured"])
            data = bytes(r.randrange(256) for _ in range(r.randrange(0, size + 2))) if state == "available" else None
            rows.append(access(row, r.choice([1, 2]), r.randrange(16), size, r.choice(["write", "read", "read_write"]), after=(state, data)))
    got = cells(spark, ("a", 0, 1, 40, 1, 0, 16), rows, discs)
    state: dict[int, tuple] = {}
    damaged: set[int] = set()
    for kind, x in sorted([(0, m) for m in rows] + [(1, d) for d in discs], key=lambda e: e[1][2]):
        if kind == 0:
            _, _, row, tid, address, _, size, direction, _, _, _, (how, data) = x
            if direction == "read" or how == "not_captured":
                continue
            for i in range(size if how == "unavailable" else min(len(data), size)):
                state[address + i] = (row, tid, None if how == "unavailable" else data[i])
                damaged.discard(address + i)
        else:
            _, _, row, tid, domain, lo, hi = x
            if tid not in (None, 1):
                continue
            for a in range(16):
                if (domain != "memory" or lo <= a < hi) and (tid is None or a not in state or state[a][1] == tid):
                    damaged.add(a)
                    if a in state:
                        damaged.add(a)
    for a in range(16):
        cell = got[a]["last_written"]
        if a in damaged:
            assert cell["provenance"] == "damaged" and cell["evidence"] is None and cell["value"] is None
        elif a not in state:
            assert cell["provenance"] == "unknown"
        else:
            assert (cell["provenance"], cell["value"], cell["evidence"]) == ("damaged" if state[a][2] is None else "derived", state[a][2], state[a][0])


OBS = "artifact string, timeline long, tid long, row long, obs_ordinal int, slot int, captured_width int, access string, value long, provenance string, name string"


def test_register_widths(spark):
    value = 0xFFFFFFFF12345678 - 2**64
    obs = spark.createDataFrame([("a", 0, 1, 1, 0, 1, 4, "write", value, "captured", "w1"), ("a", 0, 1, 1, 1, 2, 4, "write", value, "captured", "x2"), ("a", 0, 1, 1, 2, 3, 9, "write", 5, "captured", "x3")], OBS)
    targets = spark.createDataFrame([("a", 0, 1, 2)], "artifact string, timeline long, tid long, row long")
    none = targets.where("false")
    got = {(r["slot"], r["side"]): r for r in registers.states_at(targets, obs, none, targets).collect()}
    assert (got[1, "before"]["value"], got[1, "before"]["known_mask"]) == (0x12345678, -1)
    assert (got[2, "before"]["value"], got[2, "before"]["known_mask"]) == (0x12345678, 0xFFFFFFFF)
    assert got[3, "before"]["value"] is None and got[3, "before"]["provenance"] == "unknown"


@pytest.mark.parametrize("seed", range(4))
def test_registers_against_fold(spark, seed):
    r = random.Random(seed)
    obs, broken, replay = [], [], []
    for row in range(60):
        tid = r.choice([1, 2])
        if r.random() < 0.15:
            who = r.choice([None, tid])
            broken.append(("a", 0, row, who))
            replay += [("a", 0, t, row) for t in ([1, 2] if who is None else [who])]
        else:
            replay.append(("a", 0, tid, row))
            for n in range(r.randrange(3)):
                obs.append(("a", 0, tid, row, n, r.randrange(3), 8, r.choice(["read", "write"]), r.randrange(100), "captured", "x"))
    targets = [("a", 0, t, row) for t in (1, 2) for row in range(0, 60, 7)]
    scope = "artifact string, timeline long, tid long, row long"
    got = registers.states_at(spark.createDataFrame(targets, scope), spark.createDataFrame(obs, OBS), spark.createDataFrame(broken, "artifact string, timeline long, row long, tid long"), spark.createDataFrame(replay, scope), slots=3).collect()
    assert len(got) == len(targets) * 6
    for c in got:
        state: dict[int, tuple] = {}
        for row in range(c["target_row"] + 1):
            if any(b[2] == row and b[3] in (None, c["tid"]) for b in broken):
                state.clear()
            mine = [o for o in obs if o[2] == c["tid"] and o[3] == row]
            for phase in ("read", "write"):
                if row == c["target_row"] and phase == "write" and c["side"] == "before":
                    continue
                for o in mine:
                    if o[7] == phase:
                        state[o[5]] = (row, o[8])
        latest = max((x[3] for x in replay if x[2] == c["tid"] and x[3] <= c["target_row"]), default=None)
        held = state.get(c["slot"])
        assert (c["value"], c["evidence"]) == ((held[1], held[0]) if held else (None, None))
        assert c["provenance"] == ("unknown" if not held else "captured" if held[0] == latest else "derived")


def test_checkpoints_and_deltas(spark):
    whole = [("a", 1, s, "checkpoint") for s in range(34)] + [("a", 2, s, "checkpoint") for s in range(33)]
    assert [x["owner_row"] for x in registers.checkpoint_rows(spark.createDataFrame(whole, "artifact string, owner_row long, slot int, access string")).collect()] == [1]
    deltas = spark.createDataFrame([("a", 5, 0b1000000101, [7, 8, 9])], "artifact string, owner_row long, mask long, changed array<long>")
    assert sorted((x["slot"], x["value"]) for x in registers.expand_deltas(deltas).collect()) == [(0, 7), (2, 8), (9, 9)]


STEPS = "artifact string, timeline long, tid long, row long, kind string, pc long, flags long, displacement long, pc_kind int, reads array<struct<slot:int,value:long>>, category string, name string, phase string, provenance string"


def steps(spark, *rows, **options):
    full = [("a", 0, r.get("tid", 1), i, r.get("kind", "instruction"), r.get("pc"), r.get("flags", 0), r.get("disp", 0), r.get("pc_kind", 0), r.get("reads"), r.get("category"), r.get("name"), r.get("phase"), r.get("provenance", "captured")) for i, r in enumerate(rows)]
    return calltree.build(spark.createDataFrame(full, STEPS), **options).collect()


CALL, RET, BRANCH = calltree.CALL, calltree.RETURN, calltree.BRANCH


def nodes(found):
    return {r["id"]: r for r in found if r["item"] == "node"}


def test_nested_calls(spark):
    found = nodes(steps(spark, {"pc": 0x1000, "flags": CALL, "disp": 0x100, "pc_kind": 1}, {"pc": 0x1100, "flags": CALL, "disp": 0x100, "pc_kind": 1}, {"pc": 0x1200, "flags": RET}, {"pc": 0x1104, "flags": RET}, {"pc": 0x1004}))
    assert [(n["parent"], n["target"], n["target_evidence"], n["closed"]) for n in found.values()] == [(None, 0x1100, "immediate", "complete"), (0, 0x1200, "immediate", "complete")]


def test_unwind_and_unmatched(spark):
    found = steps(spark, {"pc": 0x1000, "flags": CALL}, {"pc": 0x1100, "flags": CALL}, {"pc": 0x1200, "flags": RET}, {"pc": 0x1004}, {"pc": 0x1008, "flags": RET})
    n = nodes(found)
    assert (n[0]["closed"], n[1]["closed"], n[1]["provenance"]) == ("complete", "unwind", "heuristic")
    assert n[0]["target_evidence"] == "next_pc" and n[0]["target"] == 0x1100
    assert sorted(r["item"] for r in found if r["item"] != "node") == ["unmatched_return", "unwind"]


def test_tail_call_semantics_damage(spark):
    found = steps(
        spark, {"pc": 0x1000, "flags": CALL, "disp": 0x100, "pc_kind": 1}, {"kind": "semantic_call", "category": "libc", "name": "open"}, {"pc": 0x1100, "flags": BRANCH, "disp": 0x300, "pc_kind": 1},
        {"pc": 0x1400}, {"kind": "semantic_call", "category": "libc", "name": "close"}, {"kind": "discontinuity", "tid": None}, {"pc": 0x1404, "flags": CALL},
    )
    n = nodes(found)
    assert (n[0]["closed"], n[0]["semantic"]) == ("tail_call", "libc/open")
    assert (n[1]["parent"], n[1]["closed"], n[1]["provenance"], n[1]["target"]) == (None, "discontinuity", "damaged", 0x1400)
    assert (n[2]["closed"], n[2]["target_evidence"]) == ("source_end", "unknown")
    assert [r["semantic"] for r in found if r["item"] == "semantic"] == ["libc/close"]


def intervals_of(found, item):
    return [(r["start_row"], r["end_row"], r["closed"]) for r in sorted(found, key=lambda r: r["id"]) if r["item"] == item]


def test_addresses_keep_all_bits(spark):
    top = 2**64 - 0x1000
    found = nodes(steps(spark, {"pc": top + 1 - 2**64, "flags": CALL, "disp": 0x2, "pc_kind": 1}, {"kind": "semantic_call", "category": "c", "name": "n"}, {"pc": top + 1 - 2**64, "flags": CALL, "disp": 0x2002, "pc_kind": 1}, {"pc": 8, "flags": CALL, "disp": -9, "pc_kind": 1}))
    assert [(n["call_pc"], n["target"], n["target_evidence"]) for n in found.values()] == [(top + 1 - 2**64, top + 3 - 2**64, "immediate"), (top + 1 - 2**64, 8, "next_pc"), (8, None, "unknown")]


def test_trace_boundary(spark):
    plain, call, ret = {"pc": 4}, {"pc": 8, "flags": CALL}, {"pc": 12, "flags": RET}
    boundary = lambda *rows: intervals_of(steps(spark, *rows), "trace_boundary")
    assert boundary(plain, plain, call, plain) == [(0, 2, "source_begin")]
    assert boundary(plain, ret, plain, {"kind": "memory"}) == [(0, 3, "source_begin")]
    assert boundary({"kind": "memory"}, {"pc": 4, "flags": BRANCH}, plain, {"kind": "discontinuity"}, plain, call) == [(1, 1, "source_begin")]
    assert boundary(call, plain) == boundary(ret, plain) == boundary({"kind": "signal_handler_boundary", "phase": "begin"}, plain) == []


def test_signal_handlers(spark):
    begin, end = ({"kind": "signal_handler_boundary", "phase": p} for p in ("begin", "return"))
    call = {"pc": 8, "flags": CALL}
    found = steps(spark, call, begin, begin, call, end, end, begin, {"kind": "discontinuity"}, begin, {"kind": "memory"})
    assert intervals_of(found, "signal_handler") == [(1, 2, "signal_transition"), (2, 4, "complete"), (5, 5, "signal_transition"), (6, 7, "discontinuity"), (8, 9, "source_end")]
    assert [(n["closed"], n["end_row"], n["provenance"]) for n in nodes(found).values()] == [("signal_transition", 1, "captured"), ("signal_transition", 6, "captured")]
    assert nodes(steps(spark, call, {"kind": "termination", "tid": None}, {"pc": 4}))[0]["closed"] == "termination"


def test_semantics_only_directly_after_a_call(spark):
    call, said = {"pc": 8, "flags": CALL, "provenance": "derived"}, {"kind": "semantic_call", "category": "c", "name": "n"}
    found = steps(spark, call, {"pc": 4}, said, call, {"kind": "memory"}, said, call, said, said, {"pc": 3})
    assert [n["semantic"] for n in nodes(found).values()] == [None, None, "c/n"] and len(intervals_of(found, "semantic")) == 3
    assert [(n["provenance"], n["end_row"], n["closed"]) for n in nodes(found).values()] == [("derived", 9, "source_end")] * 3


def test_unwind_has_an_interval_for_each_frame(spark):
    call = lambda pc: {"pc": pc, "flags": CALL}
    found = steps(spark, call(0x100), call(0x200), call(0x300), {"pc": 0x400, "flags": RET, "provenance": "derived"}, {"pc": 0x104})
    assert intervals_of(found, "unwind") == [(3, 3, "unwind")] * 2 and {r["provenance"] for r in found if r["item"] == "unwind"} == {"derived"}
    assert [(n["closed"], n["provenance"]) for n in nodes(found).values()] == [("complete", "captured"), ("unwind", "heuristic"), ("unwind", "heuristic")]
    tail = ({"pc": 0x100, "flags": CALL}, {"pc": 0x200, "flags": BRANCH, "disp": 0x100, "pc_kind": 1}, {"pc": 0x300})
    assert len(nodes(steps(spark, *tail))) == 2 and len(nodes(steps(spark, *tail, infer_tail_calls=False))) == 1
    one, two = (calltree.tree_identity("s", 0, 1, x) for x in (True, False))
    assert one != two and calltree.tree_identity("s", 0, 1, names={4: "f"}) not in (one, two)


def test_register_evidence_and_page_target(spark):
    found = nodes(steps(spark, {"pc": 0x1234, "flags": CALL, "disp": 0x2000, "pc_kind": 2}, {"kind": "discontinuity"}, {"pc": 0x10, "flags": CALL, "reads": [(30, 5), (2, 77)]}, {"kind": "discontinuity"}, {"pc": 0x10, "flags": CALL, "reads": [(30, 5)]}))
    assert [(n["target"], n["target_evidence"]) for n in found.values()] == [(0x3000, "immediate"), (77, "register"), (5, "link_register")]


def test_replay_is_balanced_depth():
    r = random.Random(1)
    rows, depth, open_ = [], 0, []
    for i in range(200):
        if open_ and r.random() < 0.5:
            back = open_.pop()
            rows.append({"row": i, "kind": "instruction", "pc": 1, "flags": RET, "next_pc": back, "immediate": None, "reads": None, "category": None, "name": None})
        else:
            pc = 0x1000 + 64 * i
            open_.append(pc + 4)
            rows.append({"row": i, "kind": "instruction", "pc": pc, "flags": CALL, "next_pc": None, "immediate": None, "reads": None, "category": None, "name": None})
    found = calltree.replay(rows)
    done = [n for n in found if n["item"] == "node"]
    assert sum(n["closed"] == "complete" for n in done) == sum(x["flags"] == RET for x in rows)
    assert sum(n["closed"] == "source_end" for n in done) == len(open_)


def test_history(spark):
    rows = [access(0, 1, 10, 4, "write"), access(1, 2, 12, 4, "read"), access(5, 1, 10, 4, "read")]
    target = spark.createDataFrame([("a", 0, 1, 4, 1, 13, 14)], TARGETS)
    assert sorted(r["row"] for r in memory.history(target, spark.createDataFrame(rows, MEMORY)).collect()) == [0, 1]
    with pytest.raises(Exception, match="too many"):
        memory.history(target, spark.createDataFrame(rows, MEMORY), cap=1).collect()


def shuffled(df):
    """Rows that the exchanges of a collected frame wrote."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return walk(plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_history_shuffles_no_pairs(spark):
    rows = [access(i, i % 3, 8 * (i % 5), 8, "read") for i in range(500)]
    targets = spark.createDataFrame([("a", 0, t, 499, t % 3, 4, 20) for t in range(200)], TARGETS)
    found = memory.history(targets, spark.createDataFrame(rows, MEMORY))
    assert len(found.collect()) == 200 * 300
    assert 0 < shuffled(found) < 200 * 300 / 4


@pytest.mark.parametrize("seed", range(2))
def test_history_against_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(intervals, "PART_ROWS", 8)
    monkeypatch.setattr(intervals, "GROUP_ROWS", 3)
    r = random.Random(seed)
    rows = [access(i, r.choice([1, 2, None]), r.choice([r.randrange(40), r.randrange(5000)]), r.choice([0, 1, 8, 16, 300]), "read") for i in range(300)]
    targets = [("a", 0, t, r.randrange(320), 1, lo := r.choice([4, 4, r.randrange(40), r.randrange(5000)]), lo + r.choice([0, 16, 16, 2000])) for t in range(60)]
    want = sorted((t[2], x[2]) for t in targets for x in rows if x[2] <= t[3] and max(t[5], x[4]) < min(t[6], x[5]))
    most = max(sum(t == w[0] for w in want) for t in range(60))
    run = lambda cap: memory.history(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(rows, MEMORY), cap)
    assert sorted((x["target"], x["row"]) for x in run(most).collect()) == want
    with pytest.raises(Exception, match="too many"):
        run(most - 1).collect()


def test_capture_text(spark):
    rows = spark.createDataFrame([("available", b"\x01\xff"), ("unavailable", None), ("not_captured", None)], "s string, b binary")
    assert [r["v"] for r in rows.select(memory.capture_state(F.col("b"), F.col("s")).alias("v")).collect()] == ["01ff", "<unavailable>", "<not-captured>"]
