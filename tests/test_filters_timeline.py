import pytest
from pyspark.sql import functions as F
from tracelake import schema
from tracelake.operators import timeline
from tracelake.operators.filters import EventFilter, FilterError, apply_filter, digest, normalized
from tracelake.schema import Trace

TOP = 2**64 - 1


@pytest.fixture(scope="module")
def trace(spark):
    rows = [
        ("a", 0, 0, 0, 1, 7, 0, "instruction", "captured"),
        ("a", 0, 1, 10, 2, 7, 1, "memory", "captured"),
        ("a", 0, 2, 20, None, None, 2, "discontinuity", "damaged"),
        ("a", 0, 3, 30, 5, 8, 3, "semantic_call", "captured"),
        ("a", 0, 4, 40, -1, 8, 4, "instruction", "captured"),
        ("a", 1, 5, 50, 6, None, 5, "memory", "captured"),
    ]
    events = spark.createDataFrame(rows, schema.EVENTS)
    modules = spark.createDataFrame([("a", 0, -4096, "hi.so"), ("a", 1, 4096, "lo.so")], schema.MODULES)
    definitions = spark.createDataFrame([("a", 0, "BL"), ("a", 1, "ldr")], "artifact string, definition long, mnemonic string").withColumn("operands", F.lit("x0"))
    instructions = spark.createDataFrame([("a", 0, 1, 16, 0), ("a", 4, 0, 8192, None)], schema.INSTRUCTIONS)
    memory = spark.createDataFrame(
        [("a", 1, 1, 32, 100, 108, 8, "read_write"), ("a", 5, None, 64, 104, 104, 0, "write")],
        "artifact string, owner_row long, module long, relative_pc long, address long, end_exclusive long, size long, direction string",
    )
    semantics = spark.createDataFrame([("a", 3, "libc", "open", "path=/x")], schema.SEMANTICS)
    obs = spark.createDataFrame([("a", 0, 0, 3, 8, "read", 1, "captured"), ("a", 0, 1, 4, 8, "write", 1, "captured"), ("a", 4, 0, 3, 8, "checkpoint", 1, "captured")], schema.REGISTER_OBS)
    return Trace(events, modules, definitions, instructions, memory, semantics, obs)


def rows(trace, **f):
    return sorted(r["source_row"] for r in apply_filter(trace, EventFilter(**f)).collect())


def test_fields(trace):
    assert rows(trace) == [0, 1, 2, 3, 4, 5]
    assert rows(trace, tids=(7,)) == [0, 1]
    assert rows(trace, sequences=((2, 5),)) == [1, 3]
    assert rows(trace, sequences=((6, TOP),)) == [4, 5]
    assert rows(trace, modules=(1,)) == [0, 1]
    assert rows(trace, relative_pc=((16, 32),)) == [0]
    assert rows(trace, relative_pc=((16, 33),)) == [0, 1]
    assert rows(trace, absolute_pc=((4096 + 16, 4096 + 17),)) == [0]
    assert rows(trace, absolute_pc=((0, 2**64 - 1),)) == [0, 1]  # row 4's sum leaves 64 bits
    assert rows(trace, mnemonic_exact=(" bl ",)) == [0]
    assert rows(trace, mnemonic_contains=("L",)) == [0]
    assert rows(trace, register_reads=(3,)) == [0]
    assert rows(trace, register_reads=(3,), register_writes=(4,)) == [0]
    assert rows(trace, register_reads=(4,)) == []
    assert rows(trace, categories=("libc",), names=("open",)) == [3]
    assert rows(trace, categories=("LIBC",)) == []
    assert rows(trace, detail_contains=("/x", "zzz")) == [3]
    assert rows(trace, mnemonic_exact=("bl",), memory=((0, 1000, ()),)) == []


def test_memory_directions(trace):
    assert rows(trace, memory=((107, 200, ("read",)),)) == [1]
    assert rows(trace, memory=((108, 200, ()),)) == []
    assert rows(trace, memory=((0, 200, ("read_write",)),)) == [1]
    assert rows(trace, memory=((0, 200, ("unknown",)),)) == []
    assert rows(trace, memory=((0, 200, ("write",)),)) == [1]  # the empty access at 104 never matches


def test_normalization_and_digest():
    a = EventFilter(sequences=((1, 2), (3, 9)), relative_pc=((0, 4), (4, 8)), mnemonic_exact=("ADD", " add"), memory=((0, 4, ("read",)), (4, 8, ("read",))))
    b = EventFilter(sequences=((1, 9),), relative_pc=((0, 8),), mnemonic_exact=("add",), memory=((0, 8, ("read",)),))
    assert normalized(a) == normalized(b) and digest(a) == digest(b)
    assert digest(a) != digest(EventFilter())
    for bad, code in (
        (EventFilter(names=("",)), "empty_text"), (EventFilter(relative_pc=((5, 5),)), "empty_range"), (EventFilter(tids=tuple(range(513))), "too_many_terms"),
        (EventFilter(modules=tuple(range(100)), relative_pc=tuple((10 * i, 10 * i + 1) for i in range(50))), "too_many_pairs"), (EventFilter(names=("x" * (1 << 20 | 1),)), "too_much_text"),
    ):
        with pytest.raises(FilterError) as e:
            normalized(bad)
        assert e.value.code == code


@pytest.mark.parametrize("limit", [1, 2, 3, 2000])
def test_pages_have_no_gap_or_repeat(trace, limit):
    cursor, seen = None, []
    while True:
        page = timeline.query_page(trace.events, "store", EventFilter(), limit, cursor)
        seen += [r["source_row"] for r in page.rows]
        assert page.total == 6 and page.exact_total
        if page.next is None:
            break
        cursor = page.next
    assert seen == [0, 1, 2, 3, 4, 5]


def test_cursor_is_bound_and_tamper_proof(trace):
    page = timeline.query_page(trace.events, "store", EventFilter(), 2)
    for store, wanted in (("other", EventFilter()), ("store", EventFilter(tids=(1,)))):
        with pytest.raises(timeline.CursorError):
            timeline.query_page(trace.events, store, wanted, 2, page.next)
    with pytest.raises(timeline.CursorError):
        timeline.decode_cursor(page.next[:-4] + "AAAA", "store", EventFilter())
    for limit in (0, 2001):
        with pytest.raises(ValueError):
            timeline.query_page(trace.events, "store", EventFilter(), limit)


def test_places(trace):
    assert timeline.locate(trace.events, 4, 3).first().asDict() == {"place": 4, "page_start": 3}
    assert timeline.locate(trace.events, 99, 3).collect() == []
    assert [r["source_row"] for r in timeline.page_at(trace.events, 4, 3).collect()] == [3, 4, 5]
    got = {r["source_row"]: r["place"] for r in timeline.row_places(trace.events).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}
    assert [r["source_row"] for r in timeline.tail(trace.events, 2, 1, 6).orderBy("sequence").collect()] == [3, 5]
    first = timeline.first_after(trace.events, 2, 1).collect()
    assert [r["source_row"] for r in first] == [1, 3] and all(r["has_more"] for r in first)


def test_display(trace):
    got = {r["source_row"]: (r["location"], r["summary"]) for r in timeline.display_rows(trace).collect()}
    assert got[0] == ("lo.so+0x10", "BL x0")
    assert got[2] == ("offset 0x14", "discontinuity")
    assert got[3] == ("offset 0x1e", "open path=/x")
