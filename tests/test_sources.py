import json
import random

import pytest
from pyspark.sql import functions as F
from tracelake.operators import access, filters, pairing
from tracelake.operators.filters import EventFilter
from tracelake.sinks import text
from tracelake.sources import lz4_frame, ring, sidecars, wire
from tracelake.sources.trace_stream import TraceStreamSource, normalize


def stream(minor=2, end=True, extra=b"", sequence=(1, 2)):
    body = wire.header(minor) + wire.encode_begin() + wire.encode_module(1, 0x1000, "libé.so")
    body += wire.encode_definition(4, "BL", {0: (8, "x0")}, {30: (8, "x30"), 1: (4, "w1")}, flags=4, displacement=-8, pc_kind=1, operands="x0, #8", memory=[(0, 255, 0, 2, 0, 2, 1, 8, -16)])
    body += wire.encode_definition(5, "", {}, {})
    body += wire.encode_instruction(sequence[0], 1, 0x10, 4, [2**64 - 1], [7, 8]) + wire.encode_access(1, 0x10, 2, 0x2000, 4, 0xFF, after=(1, b"\x01\x02\x03\x04"))
    body += wire.encode_instruction(sequence[1], 1, 0x14, 5, [], [])
    body += wire.encode_event(6, ["libc", "open"], 'a"b\n') + wire.encode_event(6, ["libc", "read"], "é" * 700, fragment=1001) + wire.encode_event(7, ["rule"], "x") + wire.encode_event(8, ["bad"], "y")
    return body + extra + ((wire.encode_end(5) if minor < 2 else wire.encode_stop(2)) if end else b"")


def test_decode():
    rows = list(wire.decode(stream()))
    assert [r["kind"] for r in rows] == ["begin", "module_definition", "instruction_definition", "instruction_definition", "instruction", "memory", "instruction", "semantic_call", "semantic_call", "semantic_rule", "semantic_error", "termination"]
    assert rows[4]["read_values"] == [-1] and rows[4]["write_values"] == [7, 8]
    assert rows[8]["detail"] == "é" * 700  # fragments cut a code point
    assert rows[-1]["terminal"]["reason"] == "thread_exit"
    assert len({r["record_ordinal"] for r in rows}) == len(rows)
    assert list(wire.decode(stream(1)))[-1]["terminal"]["return_value"] == 5
    assert [r["kind"] for r in wire.decode(stream(1, extra=wire.record(0x8001, b"zz")))][-2] == "opaque_optional"


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"XXXX" + stream()[4:], "not a trace stream"),
        (wire.header()[:5] + b"\x03" + stream()[6:], "unknown minor version"),
        (stream(extra=wire.RECORD_HEADER.pack(7, 0, 5000)), "larger than a record"),
        (stream() + wire.encode_event(7, ["r"], "x"), "record after the terminal"),
        (stream(sequence=(1, 3)), "doesn't follow"),
        (stream()[:-3], "ends inside a record"),
        (stream(extra=wire.encode_instruction(3, 1, 0, 99, [], [])), "no definition"),
        (stream(extra=wire.encode_access(9, 0, 1, 0, 1, 0)), "no module"),
        (stream(end=False), "no terminal"),
        (stream(extra=wire.record(77, b"")), "type is unknown"),
        (stream(extra=wire.encode_event(6, ["c", "n"], "abcdef", fragment=2)[: -(8 + 16 + 3 + 3 + 4)] ), "continuation"),
        (stream(0, extra=wire.encode_event(7, ["n"], "abcdef", fragment=2)), "flags that its type"),
        (stream(extra=wire.encode_access(1, 0, 1, 2**64 - 1, 2, 0)), "address space"),
        (stream(extra=wire.encode_event(7, [b"\xff"], "x")), "invalid UTF-8"),
        (stream(extra=wire.encode_module(1, 0x2000, "libé.so")), "module defined in two ways"),
        (stream(extra=wire.encode_definition(5, "NOP", {}, {})), "instruction defined in two ways"),
    ],
)
def test_strictness(data, message):
    with pytest.raises(wire.WireError, match=message):
        list(wire.decode(data))


def test_equal_redefinitions_are_records_like_any_other():
    rows = list(wire.decode(stream(extra=wire.encode_module(1, 0x1000, "libé.so") + wire.encode_definition(5, "", {}, {}))))
    assert [r["kind"] for r in rows][-3:] == ["module_definition", "instruction_definition", "termination"]


def test_partial_keeps_complete_records():
    whole = stream()
    full = [r["record_ordinal"] for r in wire.decode(whole)]
    for cut in range(80, len(whole), 37):
        rows = list(wire.decode(whole[:cut], partial=True))
        assert rows[-1]["kind"] == "truncation" and [r["record_ordinal"] for r in rows[:-1]] == full[: len(rows) - 1]


def test_frames():
    data = bytes(random.Random(1).randrange(4) for _ in range(200_000))
    two = lz4_frame.encode_frame(data[:1000]) + lz4_frame.skippable(7) + lz4_frame.encode_frame(data)
    assert lz4_frame.decode_frames(two) == (data[:1000] + data, False)
    assert lz4_frame.decode_frames(two[:-1]) == (data[:1000], True)
    assert lz4_frame.decode_frames(two + lz4_frame.skippable(9)[:-2]) == (data[:1000] + data, True)
    assert lz4_frame.decode_block(b"\x1fa\x01\x00\x05", b"", 100) == b"a" * 25  # one literal, then a match that overlaps itself
    assert lz4_frame.decode_block(b"\x00\x03\x00\x10z", b"abc", 100) == b"abcaz"
    for bad, message in ((b"zzzz", "magic"), (two[:4], "no complete frame"), (lz4_frame.MAGIC + b"\x00\x40\x00", "descriptor")):
        with pytest.raises(lz4_frame.FrameError, match=message):
            lz4_frame.decode_frames(bad)


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    at = tmp_path_factory.mktemp("streams")
    (at / "one.trace.bin").write_bytes(stream())
    (at / "two.trace.bin.lz4").write_bytes(lz4_frame.encode_frame(stream(1)) + lz4_frame.skippable(3))
    (at / "bad.trace.bin").write_bytes(b"junk")
    return str(at)


@pytest.fixture(scope="module")
def records(spark, recordings):
    spark.dataSource.register(TraceStreamSource)
    return spark.read.format("trace_stream").option("tolerant", "true").load(recordings)


def test_source_and_normalization(spark, records, recordings):
    assert {r["artifact"]: r["failure"] is not None for r in records.where("kind IN ('begin', 'failure')").collect()} == {"one.trace.bin": False, "two.trace.bin.lz4": False, "bad.trace.bin": True}
    with pytest.raises(Exception, match="no complete frame|magic"):
        spark.read.format("trace_stream").load(recordings).count()
    t = normalize(records)
    ids = [r["source_row"] for r in t.events.where("artifact = 'one.trace.bin'").orderBy("source_row").collect()]
    assert ids == list(range(12))
    assert {r["tid"] for r in t.events.select("tid").distinct().collect()} == {7}
    obs = {(r["slot"], r["access"], r["value"]) for r in t.register_obs.collect()}
    assert obs == {(0, "read", -1), (1, "write", 7), (30, "write", 8)}
    assert [r["source_row"] for r in filters.apply_filter(t, EventFilter(mnemonic_exact=("bl",), register_writes=(30,))).collect()] == [4, 4]
    assert access.call_rows(t).count() == 2


def test_text_format(spark, records, tmp_path):
    lines = [r["line"] for r in text.render(records.where("artifact = 'one.trace.bin'")).orderBy("record_ordinal").collect()]
    assert lines == [
        'TRACE_BEGIN format=4 scene="s" target="t" target_offset=0x10 base=0x1000 address=0x1010 pid=5 tid=7 profile=full compression=0 effective_buffer_bytes=4096 run_id=9',
        'INST seq=1 module="libé.so" module_base=0x1000 pc=0x1010 relative_pc=0x10 metadata_id=4 opcode=0xd503201f asm="BL x0, 0x1008" flags=0x4 condition=0 reads=[x0:8=0xffffffffffffffff] writes=[w1:4=0x7,x30:8=0x8] slow_memory_path=0 memory_operands=[base=X0,index=none,extend=none,mode=postindex,shift=0,kind=write,writeback=1,size=8,disp=-16]',
        'MEMORY module="libé.so" module_base=0x1000 pc=0x1010 relative_pc=0x10 kind=write metadata_available=1 flags=0x0 address=0x2000 size=4 value=0xff before=<not-captured> after=01020304',
        'INST seq=2 module="libé.so" module_base=0x1000 pc=0x1014 relative_pc=0x14 metadata_id=5 opcode=0xd503201f asm="<undecoded>" flags=0x0 condition=0 reads=[] writes=[] slow_memory_path=0 memory_operands=[]',
        'CALL category="libc" name="open" detail="a\\"b\\n"',
        f'CALL category="libc" name="read" detail="{"é" * 700}"',
        'RULE name="rule" detail="x"',
        'ERROR name="bad" detail="y"',
        "TRACE_END status=stopped reason=thread_exit return_valid=0 elapsed_ms=1 instructions=1 encoded_bytes=1 compressed_bytes=1 cache_hits=1 cache_misses=1 cache_collisions=1 buffer_swaps=1 producer_waits=1 producer_wait_ns=1 effective_buffer_bytes=1",
    ]
    out = str(tmp_path / "out")
    text.write_text(text.render(records), out)
    assert spark.read.text(out).where("artifact = 'one.trace.bin'").count() == 9
    with pytest.raises(Exception, match="already exists"):
        text.write_text(text.render(records), out)
    text.write_text(text.render(records), out, force=True)


def chunk(tid, generation, first, records):
    data = ring.encode_record(1, first, ring.encode_chunk_begin(tid), generation)
    data += ring.encode_record(9, first + 1, b"".join(i.to_bytes(8, "little") for i in range(34)), generation, 1)
    for n, (kind, flags, payload) in enumerate(records):
        data += ring.encode_record(kind, first + 2 + n, payload, generation, flags)
    return data, first, first + 1 + len(records)


def strings(*values):
    return [(6, 3, (i + 1).to_bytes(4, "little") + len(v).to_bytes(4, "little") + v) for i, v in enumerate(values)]


def words(*ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.fixture(scope="module")
def ring_file(tmp_path_factory):
    definition = wire.encode_definition(1, "RET", {30: (8, "x30")}, {}, flags=8)
    a, a1, a2 = chunk(7, 3, 10, [(4, 1, definition), (4, 0, wire.encode_instruction(1, 1, 8, 1, [99], [])), (9, 0, (0b101).to_bytes(8, "little") + words(5, 0, 6, 0)), *strings(b"libc", b"open", "é".encode()), (6, 0, words(1, 2, 3)), (5, 0, wire.encode_access(1, 8, 1, 64, 2, 3))])
    piece = lambda i: ring.FRAGMENT.pack(77, 2, i, 2) + words(1, 2, 3 + i)
    b, b1, b2 = chunk(8, 1, 40, [*strings(b"libc", b"read", b"\xc3", b"\xa9"), (6, 4, piece(0)), (6, 4, piece(1))])
    c, c1, c2 = chunk(8, 2, 60, [*strings(b"", b"x", b"d"), (6, 4, ring.FRAGMENT.pack(78, 4, 0, 2) + words(1, 2, 3))])
    broken = bytearray(c)
    broken[30] ^= 255
    good = ring.encode_emergency
    cells = {(0, 0): good(11, 7, 50, 2), (0, 1): good(12, 7, 51, 4), (1, 0): good(11, 8, 60, 2), (1, 1): good(11, 8, 55, 8), (2, 0): good(14, 7, 70, 2), (2, 1): good(11, 7, 71, 8), (3, 0): good(11, 7, 80, 2)[:-8] + bytes(4) + (2).to_bytes(4, "little")}
    at = tmp_path_factory.mktemp("ring") / "run.ring"
    at.write_bytes(ring.encode_ring([(7, 3, 2, a, a1, a2), (8, 1, 1, b + b"\x07" * 40, b1, b2), (8, 2, 2, c, c1, c2), (8, 4, 2, bytes(broken), 90, 99), (9, 1, 0, b"", 0, 0)], cells=cells))
    return str(at)


def test_ring(spark, ring_file):
    spark.dataSource.register(ring.RingSource)
    rows = spark.read.format("trace_ring").load(ring_file)
    kinds = [r["kind"] for r in rows.where("chunk = 0").orderBy("record_ordinal").collect()]
    assert kinds == ["chunk_begin", "register_checkpoint", "instruction", "register_delta", "call", "memory"]
    assert rows.where("kind = 'discontinuity'").select("chunk").collect()[0]["chunk"] == 3
    got = rows.where("kind = 'instruction'").first()
    assert (got["mnemonic"], got["read_values"], got["module_base"], got["tid"]) == ("RET", [99], 0x1000, 7)
    whole = {r["event_id"]: (r["detail"], r["complete"]) for r in ring.reassemble(rows).collect()}
    assert whole == {77: ("é", True), 78: (None, False)}
    headers = spark.read.format("trace_ring").option("part", "headers").load(ring_file)
    assert {r["state"]: r["chunks"] for r in ring.inspect(headers).collect()} == {"sealed": 3, "active": 1}
    assert ring.collisions(rows).count() == 0
    with pytest.raises(Exception, match="sequence used twice"):
        ring.collisions(rows.unionByName(rows)).collect()
    assert ring.sequence_breaks(rows).count() == 0
    later = spark.read.format("trace_ring").option("min_sequence", 61).option("max_sequence", 89).load(ring_file).collect()
    assert {(r["chunk"], min(x["sequence"] for x in later)) for r in later} == {(2, 61)}
    with pytest.raises(Exception, match="chunk 3: sealed record is not committed"):
        spark.read.format("trace_ring").option("on_damage", "error").load(ring_file).count()


def test_ring_directory_and_emergencies(spark, ring_file):
    spark.dataSource.register(ring.RingSource)
    threads = spark.read.format("trace_ring").option("part", "directory").load(ring_file)
    assert sorted((r["tid"], r["state"], r["reliable"]) for r in threads.collect()) == [(7, "live", True), (8, "live", True), (9, "live", True)]
    cells = spark.read.format("trace_ring").option("part", "emergency").load(ring_file)
    assert cells.where("damage IS NOT NULL").select("slot").collect()[0]["slot"] == 3
    got = sorted((r["slot"], r["sequence"]) for r in ring.current_emergencies(cells).collect())
    assert got == [(0, 50), (0, 51), (1, 55), (2, 70), (2, 71)]


def test_ring_layout_is_checked(ring_file):
    data = open(ring_file, "rb").read()
    ring.read_layout(data[:256], len(data))
    for at, message in ((0, "magic"), (4, "version"), (16, "does not match")):
        bad = bytearray(data[:256])
        bad[at] ^= 1
        with pytest.raises(ring.RingError, match=message):
            ring.read_layout(bytes(bad), len(data))


def sidecar(**change):
    v = dict.fromkeys(sidecars.INTEGERS, 24) | {"instructions": 21718, "cache_misses": 0}
    out = {"metrics_version": "3", "termination": "completed", "return_valid": "1", "profile": "full", "return": "0x0"} | {k: str(x) for k, x in v.items()}
    out |= {k: str(sidecars.cut_ratio(v[n] * by, v[d])) for k, (n, by, d) in sidecars.RATES.items()} | {"cache_hit_rate": "1.000000"}
    return "\n".join(f"{k}={x}" for k, x in (out | change).items() if x is not None) + "\n"


def test_sidecars():
    got = sidecars.parse_metrics(sidecar(), "x.trace.bin")
    assert str(got["instructions_per_second"]) == "904916.666666" and got["return_valid"] == 1
    for change, message in (
        ({"instructions_per_second": "904916.666667"}, "inconsistent rate"), ({"instructions": "21718x"}, "invalid counter"), ({"instructions": None}, "missing"), ({"other": "1", "profile": None}, "unknown"), ({"other": "1"}, "too many"),
        ({"profile": "odd"}, "invalid profile"), ({"metrics_version": "1"}, "unsupported"), ({"return": "0x01"}, "invalid profile"), ({"compression_ratio": "2.000000"}, "inconsistent rate"), ({"return_valid": "0"}, "termination"),
    ):
        with pytest.raises(ValueError, match=message):
            sidecars.parse_metrics(sidecar(**change))
    assert sidecars.parse_metrics(sidecar(instructions="021718"))["instructions"] == 21718
    real = sidecar(encoded_bytes="1672811", compressed_bytes="418202", encoded_bytes_per_second="69700458.333333", disk_bytes_per_second="17425083.333333", compression_ratio="0.249999")
    assert str(sidecars.parse_metrics(real)["compression_ratio"]) == "0.249999"
    first = real.replace("encoded_bytes", "raw_bytes").replace("return=0x0", "return=0xFF")
    first = "\n".join(x for x in first.splitlines() if not x.startswith(("metrics_version", "termination", "return_valid"))) + "\n"
    old = sidecars.parse_metrics(first, "x.trace.txt.lz4")
    assert (old["metrics_version"], old["raw_bytes"], old["return"]) == (1, 1672811, "0xff")
    with pytest.raises(ValueError, match="does not fit"):
        sidecars.parse_metrics(first, "x.trace.bin")
    with pytest.raises(ValueError, match="too large"):
        sidecars.parse_metrics(sidecar() + "x" * 65_536)
    with pytest.raises(ValueError, match="does not fit"):
        sidecars.parse_metrics(sidecar(), "x.trace.txt.lz4")
    with pytest.raises(ValueError, match="repeated"):
        sidecars.parse_metrics(sidecar(buffer_swaps=None) + "profile=full\n")


def test_session_choice_inventory_cache(spark, tmp_path):
    report = {"session": "s", "artifacts": [{"name": "a", "path": "/a", "format": "stream", "sha256": "0" * 64}, {"name": "b", "format": "stream"}, {"name": "c", "path": "/c", "format": "odd", "sha256": "x"}]}
    (tmp_path / "report.json").write_text(json.dumps(report))
    rows = {r["name"]: r["warning"] for r in sidecars.open_session(spark, str(tmp_path / "report.json")).collect()}
    assert rows == {"a": None, "b": "entry without a path", "c": "unknown format"}
    files = spark.createDataFrame([("a.trace.bin", 1), ("b.flight.bin", 5), ("c.txt", 9)], "name string, modified long")
    assert sidecars.choose(files).first()["name"] == "b.flight.bin"
    assert sidecars.choose(files, name="a.trace.bin").first()["format"] == "stream"
    assert sidecars.choose(files, newest=False).count() == 2
    assert sidecars.choose(files.where("false")).count() == 0
    got = sidecars.inventory(spark, str(tmp_path)).first()
    assert got["files"] == 1 and got["bytes"] == len(json.dumps(report))
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("x", 1)], "artifact string, v long")

    digest = sidecars.source_digest(b"data")
    for _ in range(2):
        assert sidecars.open_or_build(spark, str(tmp_path / "cache"), digest, build).count() == 1
    assert calls == [1] and digest != sidecars.source_digest(b"data", "other")


def test_symbols(spark, tmp_path):
    import struct

    from tracelake.sources.symbols_elf import load_symbols, read_symbols

    names = b"\0main\0helper\0"
    entry = lambda n, info, value, size: struct.pack("<IBBHQQ", n, info, 0, 1, value, size)
    symbols = entry(0, 0, 0, 0) + entry(1, 0x12, 0x1000, 32) + entry(6, 0x02, 0x1040, 0)
    note = struct.pack("<III", 4, 3, 3) + b"GNU\0" + b"\xab\xcd\xef\0"
    at = 64 + 56
    parts, heads = b"", [struct.pack("<IIQQQQIIQQ", *[0] * 10)]
    for kind, data, link, size in ((2, symbols, 2, 24), (3, names, 0, 0), (7, note, 0, 0)):
        heads.append(struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, at + len(parts), len(data), link, 0, 1, size))
        parts += data
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 183, 1, 0, 64, at + len(parts), 0, 64, 56, 1, 64, len(heads), 0)
    data = head + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 0, 0, 0) + parts + b"".join(heads)
    assert read_symbols(data) == ("abcdef", [(0x1000, 32, "main", 0), (0x1040, 0, "helper", 1)])
    with pytest.raises(ValueError, match="not a 64-bit"):
        read_symbols(b"MZ" + data[2:])
    (tmp_path / "lib.so").write_bytes(data)
    (tmp_path / "other").write_bytes(b"text")
    assert sorted(r["name"] for r in load_symbols(spark, str(tmp_path)).collect()) == ["helper", "main"]


def test_summary_and_export(spark):
    rows = spark.createDataFrame([(f"c{i:02d}", 2, 1, 0) for i in range(20)], "name string, scenes long, returned long, missing long")
    lines = [r["line"] for r in text.capture_summary(rows).collect()]
    assert len(lines) == 17 and lines[-1] == "and 4 further captures in the report" and lines[0] == "Capture c00: 1 returned, 1 without proof of a return, 0 missing ranges"
    events = spark.createDataFrame([(i,) for i in range(1, 9)], "sequence long")
    got = text.export_range(events, 2, 7, 3).collect()
    assert [r["sequence"] for r in got] == [3, 4, 5] and all(r["has_more"] and not r["complete"] for r in got)
    assert pairing.newest(events, "sequence", 3).count() == 3
    assert events.withColumn("a", F.lit(1)).count() == 8
