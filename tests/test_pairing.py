import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tracelake.operators import pairing


def test_scene_outcomes(spark):
    data = [
        (7, 1, 1, "enter", 10, 0x10), (7, 1, 5, "return", 20, 0x10), (7, 2, 6, "enter", 30, 0x10), (7, 2, 9, "capture_stopped", 40, 0x10),
        (7, 3, 10, "enter", 50, 0x10), (7, 4, 12, "return", 60, 0x10), (7, 5, 13, "enter", 70, 0x10), (7, 5, 14, "return", 80, 0x20), (7, 6, 15, "enter", 90, 0x10), (7, 6, 16, "return", 85, 0x10),
    ]
    rows = spark.createDataFrame(data, "tid long, id long, seq long, phase string, ns long, address long")
    got = {r["id"]: (r["state"], r["target_returned"], r["entry"], r["invalid"]) for r in pairing.lifecycle(rows, ["tid", "id"]).collect()}
    assert got == {1: ("returned", True, 1, 0), 2: ("capture_stopped", None, 6, 0), 3: ("open_at_end", None, 10, 0), 4: ("returned", True, None, 0), 5: ("open_at_end", None, 13, 1), 6: ("open_at_end", None, 15, 1)}
    states = {r["id"]: r["state"] for r in pairing.pair_boundaries(rows, ["tid", "id"]).collect()}
    assert states == {1: "returned", 2: "capture_stopped", 3: "open_at_end", 4: "orphan", 5: "invalid", 6: "invalid"}
    twice = rows.unionByName(rows.where("seq = 1"))
    with pytest.raises(Exception, match="duplicate enter"):
        pairing.pair_boundaries(twice, ["tid", "id"]).collect()


def test_lifecycle_against_a_fold(spark):
    r = random.Random(3)
    data, time = [], 0
    for seq in range(600):
        time += r.randrange(3)
        data.append((r.randrange(3), r.randrange(12), seq, r.choice(["enter", "return", "capture_stopped"]), time - r.choice([0, 0, 0, 40]), r.choice([1, 1, 1, 2])))
    calls, invalid = {}, Counter()
    for tid, number, seq, phase, ns, address in data:
        key = (tid, number)
        old = calls.get(key)
        if old and (old["address"] != address or ns < old["ns"]):
            invalid[key] += 1
            continue
        row = calls.setdefault(key, {"address": address, "entry": None})
        row |= {"ns": ns, "state": {"enter": "open_at_end", "return": "returned"}.get(phase, phase), "proved": True if phase == "return" else None}
        if phase == "enter":
            row["entry"] = seq
    rows = spark.createDataFrame(data, "tid long, id long, seq long, phase string, ns long, address long")
    got = {(x["tid"], x["id"]): (x["state"], x["target_returned"], x["entry"], x["address"], x["invalid"]) for x in pairing.lifecycle(rows, ["tid", "id"]).collect()}
    assert got == {k: (v["state"], v["proved"], v["entry"], v["address"], invalid[k]) for k, v in calls.items()}


def test_inclusive_times(spark):
    rows = spark.createDataFrame([(1, 100, 300)], "id long, entry_ns long, ending_ns long")
    assert pairing.scenes_between(rows, 300, 300).count() == 1
    assert pairing.scenes_between(rows, 0, 99).count() == 0


def test_counts_inside_nested_scenes(spark):
    scenes = spark.createDataFrame([(1, 2, 8), (1, 4, 6), (1, 9, None)], "tid long, entry long, ending long")
    events = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 5)], "tid long, r long")
    got = {r["entry"]: r["instructions"] for r in pairing.count_inside(scenes, events, "tid", "r").collect()}
    assert got == {2: 7, 4: 3, 9: None}


def syscalls(spark, data):
    return spark.createDataFrame(data, "tid long, id long, seq long, phase string, number long, pc long, schema int, raw_return long")


def test_syscalls(spark):
    data = [(1, 1, 1, "enter", 56, 4, 2, None), (1, 1, 2, "return", 56, 4, 2, -14), (1, 2, 3, "enter", 57, 4, 2, None), (1, 9, 4, "return", 57, 4, 2, 3), (1, None, 5, "enter", 60, 4, 1, None)]
    got = {(r["id"], r["outcome"]): r["error"] for r in pairing.pair_syscalls(syscalls(spark, data)).collect()}
    assert got == {(1, "paired"): 14, (2, "open"): None, (9, "orphan_return"): None, (None, "legacy_enter"): None}
    for extra, message in (((1, 1, 7, "return", 56, 4, 2, 0), "duplicate"), ((1, 2, 8, "return", 99, 4, 2, 0), "does not match"), ((1, 2, 2, "return", 57, 4, 2, 0), "does not match")):
        with pytest.raises(Exception, match=message):
            pairing.pair_syscalls(syscalls(spark, [*data, extra])).collect()


def test_signals_balance_policy(spark):
    marks = spark.createDataFrame([(1, "begin", 5, None, 11), (1, "return", 6, 5, 11), (1, "begin", 8, None, 11)], "tid long, phase string, seq long, begin_seq long, signal int")
    assert [r["begin_seq"] for r in pairing.open_signals(marks).collect()] == [8]
    threads = spark.createDataFrame([(1, "begin"), (1, "end"), (2, "begin")], "tid long, phase string")
    assert {r["tid"]: r["balance"] for r in pairing.thread_balance(threads).collect()} == {1: 0, 2: 1}
    rows = spark.createDataFrame([(1, 1, "p"), (1, 2, None), (2, 3, None), (1, 4, "other"), (1, 5, None)], "tid long, sequence long, policy string")
    seen = pairing.policy_in_effect(rows, F.col("policy").isNotNull(), F.col("policy") == "p").withColumn("source", pairing.pc_source(F.col("in_effect"), F.lit(1).cast("long"), F.lit(False)))
    on, off = (True, "qbdi_logical"), (False, "unknown")
    assert {r["sequence"]: (r["in_effect"], r["source"]) for r in seen.collect()} == {1: on, 2: on, 3: off, 4: off, 5: off}
    top = pairing.newest(rows, "sequence", 2)
    assert sorted((r["sequence"], r["omitted"]) for r in top.collect()) == [(4, 3), (5, 3)]


def test_membership(spark):
    scenes = spark.createDataFrame([(1,), (50,), (None,)], "entry long")
    gaps = spark.createDataFrame([(10, 20, "missing_sequences"), (90, 95, "coverage_gap")], "lo long, hi long, reason string")
    got = {r["entry"]: (r["membership"], r["reasons"]) for r in pairing.membership(scenes, gaps, 60).collect()}
    assert got == {1: ("uncertain", ["missing_sequences"]), 50: ("observed", []), None: ("uncertain", ["missing_entry"])}
    cover = spark.createDataFrame([(60, 60, "coverage_gap")], "lo long, hi long, reason string")
    got = {r["entry"]: r["reasons"] for r in pairing.membership(scenes, cover, 60, ["typed_damage"]).collect()}
    assert got == {1: ["coverage_gap", "typed_damage"], 50: ["coverage_gap", "typed_damage"], None: ["coverage_gap", "missing_entry", "typed_damage"]}


def test_scene_details(spark):
    from tracelake.operators import evidence

    ok = '{"schema":1,"id":18446744073709551615,"phase":"return","address":"0x10","monotonicNs":5,"returnValue":"0xffffffffffffffff"}'
    cases = [
        (ok, True), (ok.replace('"schema":1', '"schema":2'), False), (ok.replace("18446744073709551615", "0"), False), (ok.replace("18446744073709551615", "18446744073709551616"), False),
        (ok.replace('"return"', '"enter"'), False), (ok.replace('"return"', '"enter"').replace('"0xffffffffffffffff"', "null"), True), (ok.replace("0x10", "0XFF"), False),
        (ok.replace('"schema":1', '"schema":1,"schema":1'), False), (ok.replace('"schema":1,', ""), False), ("[]", False), ("x", False), (ok[:-1] + " " * 600 + "}", False),
    ]
    rows = spark.createDataFrame([("a", 7, i, "scene", t) for i, (t, _) in enumerate(cases)] + [("a", 7, 99, "other", ok)], "artifact string, tid long, seq long, name string, detail string")
    got = evidence.scene_boundaries(rows, "scene").orderBy("seq").collect()
    assert [r["valid"] for r in got] == [v for _, v in cases]
    assert (got[0]["id"], got[0]["address"], got[0]["ns"], got[0]["return_value"]) == (-1, 16, 5, -1)
    assert evidence.invalid_count(evidence.scene_boundaries(rows, "scene")).first()["invalid"] == 10


def test_syscall_details(spark):
    import json

    from tracelake.operators import evidence

    args = ["0x1", "0x20", "0x3", "0x4", "0x5", "0x6"]
    path = {"argument": 1, "address": "0x20", "status": "complete", "limit": 128, "bytesHex": "2f78", "display": "/x"}
    enter = {"schema": 2, "id": 3, "number": 56, "pc": "0x40", "args": args, "paths": [path]}
    ret = {"schema": 2, "id": 3, "number": 56, "pc": "0x40", "observed": True, "rawReturn": "0xfffffffffffffff2", "linuxErrorNumber": 14, "reason": "post_instruction"}
    old = {**{k: v for k, v in enter.items() if k != "paths"}, "schema": 1, "path": path}
    cases = [
        ("syscall-enter", enter, True), ("syscall-enter", enter | {"paths": []}, True), ("syscall-enter", enter | {"paths": [path, path]}, False), ("syscall-enter", enter | {"args": args[:5]}, False),
        ("syscall-enter", enter | {"paths": [path | {"address": "0x21"}]}, False), ("syscall-enter", enter | {"paths": [path | {"status": "truncated"}]}, False), ("syscall-enter", old, True),
        ("syscall-enter", old | {"path": None}, False), ("syscall-enter", old | {"number": 57, "path": None}, True), ("syscall-enter", enter | {"more": 1}, False),
        ("syscall-return", ret, True), ("syscall-return", ret | {"linuxErrorNumber": None}, False), ("syscall-return", ret | {"observed": False}, False),
        ("syscall-return", ret | {"observed": False, "rawReturn": None, "linuxErrorNumber": None, "reason": "capture_ended"}, True), ("syscall-enter", "svc #0", True),
    ]
    rows = spark.createDataFrame([("a", 7, i, c, d if isinstance(d, str) else json.dumps(d)) for i, (c, d, _) in enumerate(cases)], "artifact string, tid long, seq long, category string, detail string")
    got = evidence.syscalls(rows).orderBy("seq").collect()
    assert [r["valid"] for r in got] == [v for *_, v in cases]
    pairs = pairing.pair_syscalls(evidence.syscalls(rows.where("seq IN (0, 10, 14)")).where("valid")).collect()
    assert sorted((r["outcome"], r["error"]) for r in pairs) == [("legacy_enter", None), ("paired", 14)]
