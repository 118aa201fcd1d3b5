import random

import pytest
from pyspark.sql import functions as F
from tracelake.operators import intervals, metrics, ranges


def runs_of(values):
    out = []
    for v in sorted(set(values)):
        if out and v == out[-1][1] + 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_islands_and_gaps(spark, seed, monkeypatch):
    monkeypatch.setattr(ranges, "WIDE_BUCKET", 32)
    r = random.Random(seed)
    data = [(g, r.randrange(60)) for g in range(2) for _ in range(r.randrange(1, 50))]
    rows = spark.createDataFrame(data, "g long, v long")
    got = sorted((x["g"], x["lo"], x["hi"]) for x in ranges.islands(rows, "v", ["g"], bucket=8).collect())
    want = sorted((g, *p) for g in range(2) for p in runs_of(v for k, v in data if k == g))
    assert got == want
    gaps = sorted((x["g"], x["lo"], x["hi"]) for x in ranges.missing(rows, "v", ["g"], start=-3, end=70, bucket=8).collect())
    absent = [(g, *p) for g in range(2) for p in runs_of(set(range(-3, 71)) - {v for k, v in data if k == g})]
    assert gaps == sorted(absent)
    assert ranges.missing(rows, "v", ["g"], start=0).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_coalesce(spark, inclusive, monkeypatch):
    r = random.Random(5)
    data = [(a, a + r.randrange(1, 9)) for a in (r.randrange(200) for _ in range(40))]
    data += [(50, 120), (150, 151)]  # one reaches over several buckets
    rows = spark.createDataFrame([(0, a, b) for a, b in data], "g long, lo long, hi long")
    monkeypatch.setattr(ranges, "WIDE_BUCKET", 64)
    want = []
    for a, b in sorted(data):
        if want and a <= want[-1][1] + inclusive:
            want[-1][1] = max(b, want[-1][1])
        else:
            want.append([a, b])
    got = sorted([x["lo"], x["hi"]] for x in ranges.coalesce_ranges(rows, ["g"], inclusive, bucket=16).collect())
    assert got == want


def test_completeness(spark):
    data = [("whole", "sequence", 1, 5, "retained"), ("whole", "sequence", 6, 9, "retained"), ("hole", "sequence", 1, 5, "retained"), ("hole", "sequence", 7, 9, "retained"), ("lost", "sequence", 1, 9, "lost"), ("bytes", "source_bytes", 0, 4, "retained")]
    rows = spark.createDataFrame(data, "g string, domain string, lo long, hi long, cause string")
    more = [("byte hole", "source_bytes", 0, 10, "retained"), ("byte hole", "source_bytes", 20, 30, "retained"), ("late", "source_bytes", 1, 10, "retained"), ("touching", "source_bytes", 0, 10, "retained"), ("touching", "source_bytes", 10, 30, "retained"),
            ("empty", "source_bytes", 0, 0, "retained"), ("early", "sequence", 1, 2, "retained"), ("early", "sequence", 5, 9, "retained"), ("odd", "sequence", 1, 9, "retained")]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    streams = [(g, "stream", None, None) for g in ("bytes", "byte hole", "late", "touching", "empty")]
    rings = [("whole", "ring", 1, 9), ("hole", "ring", 1, 9), ("lost", "ring", 1, 9), ("early", "ring", 6, 9), ("odd", "other", 1, 9), ("none", "ring", 1, 2)]
    artifacts = spark.createDataFrame(streams + rings, "g string, format string, first long, last long")
    got = {r["g"]: r["status"] for r in ranges.completeness_status(rows, artifacts, ["g"]).collect()}
    assert got == {"whole": "complete", "hole": "unknown", "lost": "incomplete", "bytes": "complete", "byte hole": "unknown", "late": "unknown", "touching": "complete", "empty": "unknown", "early": "complete", "odd": "unknown", "none": "unknown"}
    assert {r["status"] for r in ranges.completeness_status(rows, artifacts, ["g"], reports_damage=False).collect()} == {"unknown", "incomplete"}
    gaps = spark.createDataFrame([(True, True, False), (False, True, False), (False, False, True), (False, False, None)], "damaged boolean, covered boolean, stale boolean")
    assert [(r["cause"], r["overwritten_sequences"]) for r in ranges.classify_missing(gaps).collect()] == [("checksum", False), ("lost", False), ("lost", True), ("overwritten", True)]
    assert [r["cause"] for r in ranges.canonical_causes(spark.createDataFrame([("unknown",), ("retained",), ("lost",)], "cause string")).collect()] == ["retained", "lost", "unknown"]
    worst = ranges.worst_provenance(spark.createDataFrame([("a", "derived"), ("a", "damaged"), ("b", "captured")], "g string, provenance string"), ["g"])
    assert {r["g"]: r["provenance"] for r in worst.collect()} == {"a": "damaged", "b": "captured"}


def test_rows_carry_values_over_buckets(spark):
    r = random.Random(4)
    places = r.sample(range(300), 80)
    data = [(g, at, r.choice([None, at])) for g in range(2) for at in places]
    rows = spark.createDataFrame(data, "g long, at long, v long")
    for back in (False, True):
        for strict in (False, True):
            got = {(x["g"], x["at"]): x["near"] for x in intervals.carry_rows(rows, ["g"], "at", {"near": F.col("v")}, 16, back, strict).collect()}
            for g, at, _ in data:
                seen = [v for h, a, v in data if h == g and v is not None and ((a > at if back else a < at) or (a == at and not strict))]
                assert got[g, at] == (None if not seen else min(seen) if back else max(seen))
    total = {(x["g"], x["at"]): x["n"] for x in intervals.running_sum(rows, ["g"], "at", F.col("at"), "n", width=16).collect()}
    assert all(total[g, at] == sum(a for h, a, _ in data if h == g and a <= at) for g, at, _ in data)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_and_innermost(spark, seed):
    r = random.Random(seed)
    spans = [(i, a, a + r.randrange(0, 40)) for i, a in enumerate(r.randrange(300) for _ in range(60))]
    left = spark.createDataFrame([(0, *s) for s in spans], "g long, i long, a long, b long")
    right = left.select("g", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    got = sorted((x["i"], x["j"]) for x in intervals.overlap_join(left, right, ["g"], 16, ("a", "b"), ("c", "d")).collect())
    want = sorted((i, j) for i, a, b in spans for j, c, d in spans if a < b and c < d and a < d and c < b)
    assert got == want
    points = spark.createDataFrame([(0, p) for p in range(0, 340, 3)], "g long, p long")
    inner = {x["p"]: x["i"] for x in intervals.innermost(points, left, ["g"], 16, "p", ("a", "b"), ["g", "p"], "i").collect()}
    for p in range(0, 340, 3):
        held = [(a, i) for i, a, b in spans if a <= p <= b]
        assert inner.get(p) == (max(held)[1] if held else None)


@pytest.mark.parametrize("seed", range(3))
def test_symbols(spark, seed):
    r = random.Random(seed)
    symbols = [(a, r.choice([0, 3, 30, 90]), f"s{a}") for a in sorted(r.sample(range(10, 400), 30))]
    table = spark.createDataFrame([("m", *s) for s in symbols], "module string, address long, size long, name string")
    pcs = spark.createDataFrame([("m", p) for p in range(0, 500, 7)], "module string, pc long")
    got = {x["pc"]: x["symbol"] for x in intervals.resolve_symbols(pcs, table, ["module"], 32).collect()}
    for p in range(0, 500, 7):
        inside = [s for s in symbols if s[0] <= p < s[0] + s[1]]
        before = [s for s in symbols if s[0] <= p]
        assert got[p] == (inside[-1][2] if inside else before[-1][2] if before else None)
    names = spark.createDataFrame([("m", symbols[0][0], "mine"), ("m", 0, "early")], "module string, address long, name string")
    named = {x["pc"]: x["display_name"] for x in intervals.local_names(intervals.resolve_symbols(pcs, table, ["module"], 32), names, ["module"]).collect()}
    assert named[0] == "early" and all(named[p] == "mine" for p in got if got[p] == symbols[0][2])


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    got = rows.agg(metrics.median(F.col("v")).alias("m"), metrics.nearest_rank("v", 0.95).alias("p")).first()
    assert (got["m"], got["p"]) == (2.5, 10.0)
    with pytest.raises(Exception, match="differs between runs"):
        rows.agg(metrics.constant("v", "v").alias("c")).collect()
    runs = spark.createDataFrame([("a", 10.0)] * 5 + [("b", 10.0)] * 4, "g string, elapsed_ms double")
    base = spark.createDataFrame([("a", 20.0)] * 5 + [("b", 20.0)] * 5, "g string, elapsed_ms double")
    done = metrics.speedups(runs, base, ["g"])
    assert {r["g"]: (r["speedup"], r["passed"]) for r in done.collect()} == {"a": (2.0, True), "b": (2.0, False)}
    said = {"instructions": 9, "return_value": "0xA", "decoded_events": 4, "first_instruction": "a", "last_instruction": "b"}
    five = [said | {"profile": "fast", "compressed_bytes": 10 - i, "instructions_per_second": 100.0 + i} for i in range(5)]
    frame = lambda x: spark.createDataFrame(x, "instructions long, return_value string, decoded_events long, first_instruction string, last_instruction string, profile string, compressed_bytes long, instructions_per_second double")
    first, targets = frame([five[0] | {"return_value": "0xa"}]), spark.createDataFrame([("fast", 102.0)], "profile string, target_rate double")
    got = metrics.profile_gate(frame(five), first, targets).first()
    assert (got["meets_rate_target"], got["meets_size_target"], got["largest_bytes"]) == (True, True, 10)
    assert not metrics.profile_gate(frame([*five[:4], five[0] | {"compressed_bytes": 11}]), first, targets).first()["meets_size_target"]
    for runs, message in ((five[:4], "takes 5 runs"), ([*five[:4], five[4] | {"instructions": 8}], "differs from the baseline")):
        with pytest.raises(Exception, match=message):
            metrics.profile_gate(frame(runs), first, targets).collect()
    assert metrics.gate(done).first().asDict() == {"all_passed": False, "any_passed": True, "best": 2.0, "worst": 2.0}
    assert metrics.content_identity(1, "f", 3, "x") == metrics.content_identity(1, "f", 3, "x") != metrics.content_identity(1, "f", 4, "x")


def test_long_and_short_intervals_meet(spark):
    r = random.Random(11)
    spans = [(i, a, a + r.choice([1, 5, 200, 10**4, 10**9, 2**60])) for i, a in enumerate(r.randrange(-(2**40), 2**40) if r.random() < 0.3 else r.randrange(10**5) for _ in range(80))]
    left = spark.createDataFrame([(0, *s) for s in spans], "g long, i long, a long, b long")
    right = left.select("g", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    got = sorted((x["i"], x["j"]) for x in intervals.overlap_join(left, right, ["g"], 64, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, a, b in spans for j, c, d in spans if a < d and c < b)
    points = spark.createDataFrame([(0, p) for p in [0, 99_999, 5 * 10**8, -(2**39), 2**60]], "g long, p long")
    found = sorted((x["p"], x["i"]) for x in intervals.points_in_intervals(points, left, ["g"], 64, "p", ("a", "b")).collect())
    assert found == sorted((p, i) for p in [0, 99_999, 5 * 10**8, -(2**39), 2**60] for i, a, b in spans if a <= p <= b)
    assert intervals.overlap_join(left.limit(0), right, ["g"], 64, ("a", "b"), ("c", "d")).count() == 0
