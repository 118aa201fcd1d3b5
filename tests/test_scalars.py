import pytest
from pyspark.sql import functions as F
from tracelake.functions import scalars, u64

EDGES = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]


def pattern(v):
    return v - 2**64 if v >= 2**63 else v


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_unsigned_order_and_text(spark):
    rows = spark.createDataFrame([(pattern(v), str(v)) for v in reversed(EDGES)], "c long, t string")
    got = rows.orderBy(u64.u64_key(F.col("c"))).select("t", u64.u64_str(F.col("c")).alias("d"), u64.u64_hex(F.col("c")).alias("h")).collect()
    assert [r["t"] for r in got] == [str(v) for v in EDGES]
    assert all(r["t"] == r["d"] and r["h"] == hex(int(r["t"])) for r in got)


@pytest.mark.parametrize("a", EDGES)
@pytest.mark.parametrize("b", [0, 1, 2**63, 2**64 - 1])
def test_sums(spark, a, b):
    ca, cb = u64.u64_literal(a), u64.u64_literal(b)
    assert one(spark, u64.checked_add(ca, cb)) == (pattern(a + b) if a + b < 2**64 else None)
    assert one(spark, u64.wrapping_add(ca, cb)) == pattern((a + b) % 2**64)
    assert one(spark, u64.saturating_add(ca, cb)) == pattern(min(a + b, 2**64 - 1))


def test_fixed_six_cuts(spark):
    cases = [(21718 * 1000, 24, "904916.666666"), (1, 0, "0.000000"), (2, 3, "0.666666"), (2**64 - 1, 1, "18446744073709551615.000000"), (0, 5, "0.000000")]
    for n, d, want in cases:
        assert str(one(spark, scalars.fixed_six(F.lit(str(n)).cast("decimal(38,0)"), F.lit(d)))) == want


def test_display_quote_hex(spark):
    assert one(spark, scalars.bounded_display(F.lit("a\nbééé"), 5)) == "a bé"
    assert one(spark, scalars.json_quote(F.lit('q"\\é\n'))) == '"q\\"\\\\é\\n"'
    assert one(spark, scalars.parse_hex64(F.lit("0xfffffffffffffff2"))) == -14
    assert one(spark, scalars.parse_hex64(F.lit("0xFF"))) is None
    assert one(spark, scalars.errno(F.lit(-14).cast("bigint"))) == 14
    assert one(spark, scalars.errno(F.lit(-4096).cast("bigint"))) is None
    assert one(spark, scalars.basename(F.lit("/a/b/c.so"))) == "c.so"


def test_bits_and_bytes(spark):
    assert one(spark, scalars.mask_slots(F.lit(0x200000005).cast("bigint"))) == [0, 2, 33]
    assert one(spark, scalars.width_mask(F.lit(8))) == -1
    assert one(spark, scalars.width_mask(F.lit(9))) is None
    assert one(spark, scalars.little_endian(F.lit(0x0102030405060708), F.lit(3))) == b"\x08\x07\x06"
    assert one(spark, scalars.fnv32(F.lit(b"abc"))) == 0x1A47E90B
    assert one(spark, scalars.fnv32(F.lit(b""))) == 2166136261


def test_strict_object(spark):
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1,"a":2,"b":1}',), ('{"a":1}',), ("x",), (None,), ("[1]",)], "t string")
    got = [r["v"] for r in rows.select(scalars.strict_object(F.col("t"), frozenset("ab")).alias("v")).collect()]
    assert got == [True, False, False, False, False, False]


def test_effective_address(spark):
    rows = spark.createDataFrame(
        [([100, 2, -1] + [0] * 31, (0, 1, 3, 0, 3, 1, 0, 8, -4)), ([100, 2, -1] + [0] * 31, (0, 2, 2, 0, 1, 1, 0, 8, 0)), ([100] + [0] * 33, (0, 255, 0, 2, 0, 1, 1, 8, 16))],
        "r array<long>, o struct<base:int,index:int,extend:int,address_mode:int,shift:int,access_kind:int,writeback:int,access_size:long,displacement:long>",
    )
    got = rows.select(scalars.effective_address(F.col("r"), F.col("o")).alias("a"), scalars.writeback_address(F.col("r"), F.col("o")).alias("w")).collect()
    assert [(r["a"], r["w"]) for r in got] == [(112, None), (98, None), (100, 116)]
