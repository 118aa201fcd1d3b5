"""One query for each operator over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import scalars, u64
from tracelake.operators import access, calltree, intervals, memory, metrics, pairing, ranges, registers, timeline
from tracelake.operators.filters import EventFilter, apply_filter
from tracelake.plans import views
from tracelake.plans.session import delete_at_end, shared_dir
from tracelake.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The trace view of ``events`` in SQL.
EV = """WITH ev AS (SELECT event_id AS r, user_id AS tid, event_type AS etype, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k,
  epoch_us(ts) * 1000 AS ns, value, props,
  CASE event_type WHEN 'signup' THEN 'semantic_call' WHEN 'click' THEN 'semantic_rule' WHEN 'error' THEN 'semantic_error'
    WHEN 'view' THEN 'memory' ELSE 'instruction' END AS kind,
  CASE event_type WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 WHEN 'view' THEN 1 ELSE 0 END AS flags,
  CASE event_type WHEN 'signup' THEN 'BL' WHEN 'purchase' THEN 'RET' WHEN 'view' THEN 'B' WHEN 'click' THEN 'ADD' END AS mnemonic
  FROM events),
sc AS (SELECT tid, r AS entry, CASE WHEN nt = 'purchase' THEN nr END AS ending, CASE WHEN nt = 'purchase' THEN 'returned' ELSE 'open_at_end' END AS state,
  k % 16 AS address, ns AS entry_ns, CASE WHEN nt = 'purchase' THEN nns END AS ending_ns
  FROM (SELECT *, lead(r) OVER w AS nr, lead(etype) OVER w AS nt, lead(ns) OVER w AS nns FROM ev WHERE etype IN ('signup', 'purchase') WINDOW w AS (PARTITION BY tid ORDER BY r))
  WHERE etype = 'signup')
"""


def query(sql: str | None = None, view: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (EV + sql) if view else sql
        return f

    return add


def _filtered(spark: SparkSession, sf: str, wanted: EventFilter) -> DataFrame:
    return apply_filter(views.trace(spark, sf), wanted).select("source_row", "kind", "tid")


def _filter_query(name: str, wanted: EventFilter, where: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _filtered(spark, sf, wanted)

    run.__name__ = name
    query(f"SELECT r AS source_row, kind, tid FROM ev WHERE {where}")(run)


_filter_query("f1_tids", EventFilter(tids=(3, 7, 11, 3)), "tid IN (3, 7, 11)")
_filter_query("f2_kinds", EventFilter(kinds=("memory", "semantic_error")), "kind IN ('memory', 'semantic_error')")
_filter_query("f3_modules", EventFilter(modules=(1, 3)), "etype <> 'error' AND tid % 4 IN (1, 3)")
_filter_query("f4_relative_pc", EventFilter(relative_pc=((16, 64), (60, 100), (300, 304))), "etype <> 'error' AND (k * 4 >= 16 AND k * 4 < 100 OR k * 4 >= 300 AND k * 4 < 304)")
_filter_query("f5_absolute_pc", EventFilter(absolute_pc=((4096 + 40, 8192 + 80),)), "etype <> 'error' AND 4096 * (tid % 4 + 1) + k * 4 >= 4136 AND 4096 * (tid % 4 + 1) + k * 4 < 8272")
_filter_query("f6_sequences", EventFilter(sequences=((10, 20), (21, 40), (500, 2**64 - 1))), "r BETWEEN 10 AND 40 OR r >= 500")
_filter_query("f7_mnemonic", EventFilter(mnemonic_exact=(" ret ",), mnemonic_contains=("D",)), "mnemonic = 'RET' OR contains(lower(mnemonic), 'd')")
_filter_query("f8_register_reads", EventFilter(register_reads=(0, 5, 33)), "etype = 'click' AND k % 34 IN (0, 5, 33)")
_filter_query("f9_register_writes", EventFilter(register_writes=(1, 2)), "etype = 'purchase' AND k % 34 IN (1, 2)")
_filter_query("f10_memory", EventFilter(memory=((100, 130, ("write",)), (200, 260, ()))), "etype = 'purchase' AND k * 8 < 130 AND k * 8 + 1 + r % 16 > 100 OR etype IN ('view', 'purchase') AND k * 8 < 260 AND k * 8 + 1 + r % 16 > 200")
_filter_query("f11_semantic_names", EventFilter(categories=("signup", "click"), names=("n3", "n7")), "etype IN ('signup', 'click') AND k % 10 IN (3, 7)")
_filter_query("f12_detail_contains", EventFilter(detail_contains=('"k": 1', "99")), "kind LIKE 'semantic%' AND (contains(props, '\"k\": 1') OR contains(props, '99'))")
_filter_query("f13_all_fields", EventFilter(kinds=("instruction", "memory"), modules=(0, 1, 2), sequences=((100, 10**12),), memory=((0, 400, ("read", "write")),), mnemonic_contains=("b", "r")), "kind IN ('instruction', 'memory') AND tid % 4 IN (0, 1, 2) AND r >= 100 AND k * 8 < 400 AND (contains(lower(mnemonic), 'b') OR contains(lower(mnemonic), 'r'))")


@query("SELECT r AS source_row, 'a' AS artifact, 0::BIGINT AS timeline, r AS record_ordinal, r AS source_offset, r AS sequence, tid, kind, 'captured' AS provenance, FALSE AS is_discontinuity FROM ev")
def p1_timeline_rows(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.timeline_rows(views.trace(spark, sf))


@query("""SELECT r AS source_row, CASE WHEN etype = 'error' THEN 'offset 0x' || lower(to_hex(r)) ELSE 'lib' || (tid % 4) || '+0x' || lower(to_hex(k * 4)) END AS location,
  CASE WHEN mnemonic IS NOT NULL THEN mnemonic || ' x0, x1' ELSE 'n' || (k % 10) || ' ' || props END AS summary FROM ev""")
def p2_display_rows(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.display_rows(views.trace(spark, sf)).drop("artifact")


@query("""SELECT r AS source_row, kind, r::VARCHAR AS sequence, '0x' || lower(to_hex(k * 4)) AS relative_pc, '0x' || lower(to_hex(k * 8)) AS memory_address FROM ev
  WHERE r = (SELECT min(r) FROM ev WHERE etype = 'purchase')""")
def p3_event_detail(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    first = views.log(spark, sf).where("etype = 'purchase'").agg(F.min("r")).first()[0]
    return timeline.event_detail(t, first).select("source_row", "kind", "sequence", "relative_pc", "memory_address")


@query("SELECT r, ((18446744073709551615::HUGEINT - r) % 18446744073709551616::HUGEINT)::VARCHAR AS as_decimal, '0x' || lower(to_hex((18446744073709551615::HUGEINT - r)::UBIGINT)) AS as_hex FROM ev")
def p4_unsigned_text(spark: SparkSession, sf: str) -> DataFrame:
    c = F.bitwise_not(F.col("r"))  # the pattern of 2**64 - 1 - r
    return views.log(spark, sf).select("r", u64.u64_str(c).alias("as_decimal"), u64.u64_hex(c).alias("as_hex"))


# Pages and places.  The limits below are the feature itself.
@query("SELECT r AS source_row, tid, kind FROM ev WHERE kind = 'memory' OR kind = 'semantic_error' AND contains(props, '1') ORDER BY r LIMIT 500")
def l1_key_order(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    said = apply_filter(t, EventFilter(kinds=("semantic_error",), detail_contains=("1",)))
    rows = apply_filter(t, EventFilter(kinds=("memory",))).unionByName(said)
    return timeline.page(rows, 500).select("source_row", "tid", "kind")


@query("SELECT r AS source_row, tid, kind FROM ev WHERE kind IN ('semantic_call', 'semantic_rule') AND contains(props, '2') AND r > 50 ORDER BY r LIMIT 200")
def l2_filtered_page(spark: SparkSession, sf: str) -> DataFrame:
    wanted = EventFilter(kinds=("semantic_call", "semantic_rule"), detail_contains=("2",))
    rows = apply_filter(views.trace(spark, sf), wanted)
    return timeline.page(rows, 200, ("a", 0, 50, 2**62, None, None)).select("source_row", "tid", "kind")


@query("SELECT count(*) FILTER (r < m) AS place, (count(*) FILTER (r < m) // 100 * 100)::BIGINT AS page_start FROM ev, (SELECT max(r) AS m FROM ev WHERE kind = 'memory') WHERE kind = 'memory'")
def l3_locate_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = apply_filter(views.trace(spark, sf), EventFilter(kinds=("memory",)))
    last = rows.agg(F.max("source_row")).first()[0]
    return timeline.locate(rows, last, 100)


@query("SELECT r AS source_row, kind, row_number() OVER (ORDER BY r) - 1 AS place FROM ev WHERE kind = 'memory'")
def l3_all_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = apply_filter(views.trace(spark, sf), EventFilter(kinds=("memory",)))
    return timeline.row_places(rows).select("source_row", "kind", "place")


@query("SELECT r AS source_row, kind FROM ev ORDER BY r LIMIT 100 OFFSET 300")
def l4_page_at_offset(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.page_at(views.trace(spark, sf).events, 345, 100).select("source_row", "kind")


@query("SELECT r AS source_row, TRUE AS has_more FROM ev WHERE r > 10 AND r <= 900 ORDER BY r DESC LIMIT 30")
def l5_tail(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.tail(views.trace(spark, sf).events, 30, 10, 900).select("source_row", "has_more")


@query("SELECT r AS source_row, TRUE AS has_more FROM ev WHERE r > 100 AND r <= 900 ORDER BY r LIMIT 30")
def l6_first_after(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.first_after(views.trace(spark, sf).events, 30, 100, 900).select("source_row", "has_more")


@query("SELECT tid, seq, ns FROM (SELECT tid, entry AS seq, entry_ns AS ns FROM sc UNION ALL SELECT tid, ending, ending_ns FROM sc WHERE ending IS NOT NULL) WHERE seq > 20 AND ns BETWEEN (SELECT min(ns) FROM ev) AND (SELECT max(ns) FROM ev) ORDER BY seq LIMIT 50")
def l7_boundaries_in_time(spark: SparkSession, sf: str) -> DataFrame:
    found = views.scenes(spark, sf)
    marks = found.select("tid", F.col("entry").alias("seq"), F.col("entry_ns").alias("ns")).unionByName(
        found.where("ending IS NOT NULL").select("tid", F.col("ending").alias("seq"), F.col("ending_ns").alias("ns"))
    )
    lo, hi = views.log(spark, sf).agg(F.min("ns"), F.max("ns")).first()
    return pairing.scene_boundaries_between(marks, lo, hi, 20, 50)


@query("""SELECT e.tid, e.r, max(s.entry) AS entry FROM ev e JOIN sc s ON e.tid = s.tid AND s.ending IS NOT NULL AND e.r BETWEEN s.entry AND s.ending GROUP BY 1, 2""")
def l8_events_of_scenes(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).select("tid", "r", "ns")
    lo, hi = rows.agg(F.min("ns"), F.max("ns")).first()
    whole = pairing.scenes_between(views.scenes(spark, sf).where("state = 'returned'"), lo, hi).select("tid", "entry", "ending", F.col("entry").alias("scene"))
    found = intervals.innermost(rows.select("tid", "r"), whole, ["tid"], 1024, "r", ("entry", "ending"), ["tid", "r"], "scene")
    return found.withColumnRenamed("scene", "entry")


# Joins.
@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", view=False)
def j1_dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: views.table(spark, sf, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT r AS source_row, kind, k * 4 AS relative_pc FROM ev WHERE etype <> 'error'")
def j2_owner_join(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return t.events.join(t.instructions.withColumnRenamed("owner_row", "source_row"), ["artifact", "source_row"]).select("source_row", "kind", "relative_pc")


@query("SELECT r AS source_row FROM ev WHERE etype = 'purchase' AND tid % 4 = 1")
def j3_intersect_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return access.intersect_rows([access.rows_for_modules(t, [1]), access.return_rows(t)]).select("source_row")


@query("SELECT r AS source_row FROM ev WHERE etype IN ('purchase', 'signup')")
def j4_union_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return access.union_rows([access.call_rows(t), access.return_rows(t), access.call_rows(t)]).select("source_row")


@query("""SELECT p_partkey, p2.pk AS other FROM part p JOIN (SELECT p_partkey AS pk, p_partkey * 10 AS a, p_partkey * 10 + p_size AS b FROM part) p2
  ON p.p_partkey * 10 < p2.b AND p2.a < p.p_partkey * 10 + p.p_size WHERE p.p_partkey < p2.pk""", view=False)
def j5_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("a"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("b"), F.lit(0).alias("g"))
    other = spans.select(F.col("p_partkey").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"), "g")
    return intervals.overlap_join(spans, other, ["g"], 64, ("a", "b"), ("oa", "ob")).where("p_partkey < other").select("p_partkey", "other")


@query("SELECT e.tid, e.r, max(s.entry) AS scene FROM ev e JOIN sc s ON e.tid = s.tid AND s.ending IS NOT NULL AND e.r BETWEEN s.entry AND s.ending GROUP BY 1, 2")
def j6_innermost_scene(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.scenes(spark, sf).where("ending IS NOT NULL").select("tid", "entry", "ending", F.col("entry").alias("scene"))
    return intervals.innermost(views.log(spark, sf).select("tid", "r"), spans, ["tid"], 2048, "r", ("entry", "ending"), ["tid", "r"], "scene")


@query("SELECT tid, entry, ending, (SELECT count(*) > 20 FROM sc WHERE entry <= 500 AND ending >= 500) AS has_more FROM sc WHERE entry <= 500 AND ending >= 500 ORDER BY entry DESC LIMIT 20")
def j7_stabbing(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.stabbing(views.scenes(spark, sf).select("tid", "entry", "ending"), 500, 20, ("entry", "ending"))


_SYMBOLS_SQL = """sy AS (SELECT p_partkey * 10 AS a, p_size AS n, p_name AS name FROM part),
pcs AS (SELECT DISTINCT l_partkey * 10 + l_linenumber AS pc FROM lineitem),
held AS (SELECT pc, max(struct_pack(a := a, name := name)) AS s FROM pcs JOIN sy ON a <= pc AND pc < a + n GROUP BY pc),
near AS (SELECT pc, sy.a, sy.name FROM pcs ASOF LEFT JOIN sy ON pcs.pc >= sy.a),
found AS (SELECT near.pc, coalesce(s.name, near.name) AS symbol, coalesce(s.a, near.a) AS symbol_address FROM near LEFT JOIN held USING (pc))
"""


def _symbols(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = F.lit("m").alias("module")
    symbols = views.table(spark, sf, "part").select(g, (F.col("p_partkey") * 10).alias("address"), F.col("p_size").cast("bigint").alias("size"), F.col("p_name").alias("name"))
    pcs = views.table(spark, sf, "lineitem").select(g, (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pc")).distinct()
    return pcs, symbols


@query("WITH " + _SYMBOLS_SQL + "SELECT pc, symbol, symbol_address, pc - symbol_address AS symbol_offset FROM found", view=False)
def j8_resolve_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.resolve_symbols(*_symbols(spark, sf), ["module"]).drop("module")


@query("WITH " + _SYMBOLS_SQL + """SELECT pc, coalesce(own.name, symbol) AS display_name FROM found LEFT JOIN
  (SELECT s_suppkey * 100 AS at, s_name AS name FROM supplier) own ON own.at = coalesce(symbol_address, pc)""", view=False)
def j9_local_names(spark: SparkSession, sf: str) -> DataFrame:
    names = views.table(spark, sf, "supplier").select(F.lit("m").alias("module"), (F.col("s_suppkey") * 100).alias("address"), F.col("s_name").alias("name"))
    resolved = intervals.resolve_symbols(*_symbols(spark, sf), ["module"])
    return intervals.local_names(resolved, names, ["module"]).select("pc", "display_name")


_BOUNDS_SQL = """b AS (SELECT tid, etype, ns, r AS seq, row_number() OVER (PARTITION BY tid, etype ORDER BY r) AS id, k % 16 AS address FROM ev WHERE etype IN ('signup', 'purchase')),
pair AS (SELECT coalesce(e.tid, x.tid) AS tid, coalesce(e.id, x.id) AS id, e.seq AS entry, x.seq AS ending,
  CASE WHEN x.seq IS NULL THEN 'open_at_end' WHEN e.seq IS NULL THEN 'orphan' WHEN e.seq < x.seq AND e.ns <= x.ns AND e.address = x.address THEN 'returned' ELSE 'invalid' END AS state
  FROM (SELECT * FROM b WHERE etype = 'signup') e FULL OUTER JOIN (SELECT * FROM b WHERE etype = 'purchase') x ON e.tid = x.tid AND e.id = x.id)
"""


def _boundaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).where("etype IN ('signup', 'purchase')")
    number = F.row_number().over(Window.partitionBy("tid", "etype").orderBy("r"))
    phase = F.when(F.col("etype") == "signup", "enter").otherwise("return")
    return rows.select("tid", number.cast("bigint").alias("id"), F.col("r").alias("seq"), "ns", phase.alias("phase"), F.pmod("k", F.lit(16)).alias("address"))


@query(", " + _BOUNDS_SQL + "SELECT tid, id, entry, ending, state FROM pair")
def j10_pair_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.pair_boundaries(_boundaries(spark, sf), ["tid", "id"]).select("tid", "id", "entry", "ending", "state")


@query(""", b AS (SELECT tid, k % 8 AS id, r AS seq, CASE etype WHEN 'signup' THEN 'enter' WHEN 'purchase' THEN 'return' ELSE 'capture_stopped' END AS phase,
  CASE WHEN r % 5 = 0 THEN 2 ELSE 1 END AS address, ns - CASE WHEN r % 11 = 0 THEN 100000000000000 ELSE 0 END AS t FROM ev WHERE etype IN ('signup', 'purchase', 'error')),
f AS (SELECT *, first_value(address) OVER (PARTITION BY tid, id ORDER BY seq) AS own FROM b),
g AS (SELECT *, max(CASE WHEN address = own THEN t END) OVER (PARTITION BY tid, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM f),
v AS (SELECT *, address = own AND (upto IS NULL OR t >= upto) AS good FROM g)
SELECT tid, id, max(CASE WHEN good AND phase = 'enter' THEN seq END) AS entry, CASE arg_max(phase, seq) FILTER (good) WHEN 'enter' THEN 'open_at_end' WHEN 'return' THEN 'returned' ELSE 'capture_stopped' END AS state,
  CASE WHEN arg_max(phase, seq) FILTER (good) = 'return' THEN TRUE END AS target_returned, count(*) FILTER (NOT good) AS invalid FROM v GROUP BY tid, id""")
def j10_scene_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    phase = F.when(F.col("etype") == "signup", "enter").when(F.col("etype") == "purchase", "return").otherwise("capture_stopped")
    time = F.col("ns") - F.when(F.pmod(r, F.lit(11)) == 0, 100_000_000_000_000).otherwise(0)
    rows = views.log(spark, sf).where("etype IN ('signup', 'purchase', 'error')").select(
        "tid", F.pmod("k", F.lit(8)).alias("id"), r.alias("seq"), phase.alias("phase"), F.when(F.pmod(r, F.lit(5)) == 0, 2).otherwise(1).alias("address"), time.alias("ns")
    )
    return pairing.lifecycle(rows, ["tid", "id"]).select("tid", "id", "entry", "state", "target_returned", "invalid")


@query(""", b AS (SELECT tid, etype, r AS seq, row_number() OVER (PARTITION BY tid, etype ORDER BY r) AS id, k FROM ev WHERE etype IN ('view', 'click')),
two AS (SELECT e.tid, e.id, e.seq AS s1, x.seq AS s2, x.k FROM (SELECT * FROM b WHERE etype = 'view') e JOIN (SELECT * FROM b WHERE etype = 'click') x USING (tid, id))
SELECT e.tid, e.id, e.seq AS entry, CASE WHEN s2 > s1 THEN s2 END AS ending, CASE WHEN s2 > s1 THEN 'paired' ELSE 'open' END AS outcome,
  CASE WHEN s2 > s1 THEN two.k - 50 END AS raw_return, CASE WHEN s2 > s1 AND two.k - 50 BETWEEN -4095 AND -1 THEN 50 - two.k END AS error
FROM b e LEFT JOIN two ON e.tid = two.tid AND e.id = two.id WHERE e.etype = 'view'""")
def j11_pair_syscalls(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).where("etype IN ('view', 'click')")
    numbered = rows.withColumn("id", F.row_number().over(Window.partitionBy("tid", "etype").orderBy("r")).cast("bigint"))
    first = numbered.where("etype = 'view'").select("tid", "id", F.col("r").alias("enter_seq"))
    later = numbered.join(first, ["tid", "id"]).where("etype = 'view' OR r > enter_seq")
    phase = F.when(F.col("etype") == "view", "enter").otherwise("return")
    calls = later.select("tid", "id", F.col("r").alias("seq"), phase.alias("phase"), F.lit(56).alias("number"), F.lit(4).alias("pc"), F.lit(2).alias("schema"), (F.col("k") - 50).alias("raw_return"))
    return pairing.pair_syscalls(calls).drop("number")


@query(", n AS (SELECT tid, r, etype, lead(etype) OVER (PARTITION BY tid ORDER BY r) AS nt FROM ev WHERE etype IN ('view', 'click')) SELECT tid, r AS begin_seq FROM n WHERE etype = 'view' AND nt IS DISTINCT FROM 'click'")
def j12_open_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).where("etype IN ('view', 'click')")
    before = Window.partitionBy("tid").orderBy("r")
    marked = rows.withColumn("prev_type", F.lag("etype").over(before)).withColumn("prev_r", F.lag("r").over(before))
    begins = marked.where("etype = 'view'").select("tid", F.lit("begin").alias("phase"), F.col("r").alias("seq"), F.lit(None).cast("bigint").alias("begin_seq"), F.lit(11).alias("signal"))
    returns = marked.where("etype = 'click' AND prev_type = 'view'").select("tid", F.lit("return").alias("phase"), F.col("r").alias("seq"), F.col("prev_r").alias("begin_seq"), F.lit(11).alias("signal"))
    return pairing.open_signals(begins.unionByName(returns)).drop("signal")


@query("SELECT r AS owner_row, 4096 * (tid % 4 + 1) + k * 4 AS absolute_pc FROM ev WHERE etype <> 'error'")
def j13_absolute_pcs(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return t.instructions.join(t.modules, ["artifact", "module"]).select("owner_row", u64.checked_add(F.col("base"), F.col("relative_pc")).alias("absolute_pc"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", view=False)
def j15_orders_without_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return views.table(spark, sf, "orders").select("o_orderkey").distinct().join(lines, "o_orderkey", "left_anti")


# Aggregates.
@query("SELECT kind, count(*) AS n, sum(r % 100)::BIGINT AS claimed FROM ev GROUP BY kind")
def a1_count_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return views.log(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.pmod("r", F.lit(100))).alias("claimed"))


_INSIDE_SQL = """inside AS (SELECT sc.tid, sc.entry, sc.ending, sc.state, sc.address,
  CASE WHEN sc.ending IS NOT NULL THEN (SELECT count(*) FROM ev WHERE ev.tid = sc.tid AND ev.r BETWEEN sc.entry AND sc.ending) END AS instructions FROM sc)
"""


def _counted_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.count_inside(views.scenes(spark, sf), views.log(spark, sf), "tid", "r")


@query(", " + _INSIDE_SQL + """SELECT address, count(entry) AS entries, count(*) FILTER (state = 'returned') AS returned, sum(instructions)::BIGINT AS instructions,
  min(entry) AS first_entry, max(ending) AS last_ending FROM inside GROUP BY address ORDER BY first_entry DESC LIMIT 256""")
def a2_scene_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.scene_summary(_counted_scenes(spark, sf))


@query("SELECT greatest(0, count(DISTINCT address) - 10)::BIGINT AS omitted FROM sc")
def a3_omitted_groups(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.omitted_groups(views.scenes(spark, sf), "address", 10)


@query(", " + _INSIDE_SQL + "SELECT tid, entry, instructions FROM inside")
def a4_instructions_inside(spark: SparkSession, sf: str) -> DataFrame:
    return _counted_scenes(spark, sf).select("tid", "entry", "instructions")


@query("SELECT tid, sum(CASE etype WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END)::BIGINT AS balance FROM ev GROUP BY tid")
def a5_thread_balance(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.when(F.col("etype") == "signup", "begin").when(F.col("etype") == "purchase", "end").otherwise("other")
    return pairing.thread_balance(views.log(spark, sf).withColumn("phase", phase))


@query("SELECT tid, max(r) AS last_seq, arg_max(kind, r) AS last_kind FROM ev GROUP BY tid")
def a6_last_of_threads(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.last_of_threads(views.trace(spark, sf).events)


@query("SELECT r AS sequence, tid FROM ev ORDER BY r DESC, tid DESC LIMIT 1")
def a6_last_recorded_thread(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.last_recorded_thread(views.trace(spark, sf).events)


@query("SELECT max(r) AS seq, arg_max(tid, r) AS tid FROM ev WHERE etype = 'error'")
def a7_last_signal(spark: SparkSession, sf: str) -> DataFrame:
    return views.log(spark, sf).where("etype = 'error'").agg(F.max("r").alias("seq"), F.max_by("tid", "r").alias("tid"))


@query("SELECT k * 4 AS pc FROM ev WHERE etype <> 'error' AND k <> 0 GROUP BY 1")
def a8_distinct_pcs(spark: SparkSession, sf: str) -> DataFrame:
    return views.trace(spark, sf).instructions.where("relative_pc <> 0").select(F.col("relative_pc").alias("pc")).distinct()


@query("SELECT DISTINCT tid FROM ev")
def a9_distinct_tids(spark: SparkSession, sf: str) -> DataFrame:
    return views.trace(spark, sf).events.where("tid IS NOT NULL").select("tid").distinct()


_KEYS = "WITH v AS (SELECT DISTINCT l_orderkey AS v FROM lineitem), g AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM v), runs AS (SELECT min(v) AS lo, max(v) AS hi FROM g GROUP BY g)\n"


@query(_KEYS + "SELECT lo, hi FROM runs", view=False)
def a10_islands(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.islands(views.table(spark, sf, "lineitem"), "l_orderkey")


@query(_KEYS + "SELECT hi + 1 AS lo, nxt - 1 AS hi FROM (SELECT hi, lead(lo) OVER (ORDER BY lo) AS nxt FROM runs) WHERE nxt IS NOT NULL UNION ALL SELECT 1, min(lo) - 1 FROM runs HAVING min(lo) > 1", view=False)
def a11_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.missing(views.table(spark, sf, "lineitem"), "l_orderkey", start=1)


@query("""WITH d AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders), v AS (SELECT DISTINCT l_orderkey AS v FROM lineitem),
n AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM v)
SELECT 0 AS g, v + 1 AS lo, nx - 1 AS hi, 'inner' AS part FROM n WHERE nx > v + 1
UNION ALL SELECT 0, a, (SELECT min(v) FROM v) - 1, 'head' FROM d WHERE a <= (SELECT min(v) FROM v) - 1
UNION ALL SELECT 0, (SELECT max(v) FROM v) + 1, b, 'tail' FROM d WHERE (SELECT max(v) FROM v) + 1 <= b""", view=False)
def a12_declared_gaps(spark: SparkSession, sf: str) -> DataFrame:
    seen = views.table(spark, sf, "lineitem").select(F.lit(0).alias("g"), "l_orderkey")
    declared = views.table(spark, sf, "orders").select(F.lit(0).alias("g"), F.col("o_orderkey").alias("first"), F.col("o_orderkey").alias("last"))
    return ranges.declared_gaps(seen, declared, "l_orderkey", ["g"])


_RANGES_SQL = "WITH x AS (SELECT o_orderstatus AS cause, o_orderkey AS lo, o_orderkey + o_custkey % 5 AS hi FROM orders),\n"


def _order_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cause"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.pmod("o_custkey", F.lit(5))).alias("hi"))


@query(_RANGES_SQL + """m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY cause ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS s FROM x),
g AS (SELECT *, sum(s) OVER (PARTITION BY cause ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT cause, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY cause, run""", view=False)
def a13_coalesce_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.coalesce_ranges(_order_ranges(spark, sf), ["cause"])


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders),
x AS (SELECT k % 199 AS g, k, row_number() OVER (PARTITION BY k % 199 ORDER BY k) - 1 AS i FROM o),
y AS (SELECT g, CASE g % 3 WHEN 0 THEN 'stream' WHEN 1 THEN 'ring' ELSE 'other' END AS format, i * 10 + CASE WHEN g % 3 = 0 THEN 0 ELSE 1 END AS lo, i * 10 + CASE WHEN k % 151 = 0 THEN 5 ELSE 10 END AS hi,
  CASE WHEN k % 211 = 0 THEN 'lost' ELSE 'retained' END AS cause FROM x),
z AS (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM y),
s AS (SELECT g, format, bool_or(cause <> 'retained') AS bad, bool_or(lo > coalesce(upto, 0) + CASE WHEN format = 'ring' THEN 1 ELSE 0 END) AS hole FROM z GROUP BY ALL)
SELECT g, CASE WHEN bad THEN 'incomplete' WHEN format <> 'other' AND NOT hole THEN 'complete' ELSE 'unknown' END AS status FROM s""", view=False)
def a14_completeness_status(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with holes, losses and unknown formats; the last range's end is not checked for streams."""
    k, g = F.col("k"), F.col("g")
    keys = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("g", F.pmod(k, F.lit(199)))
    at = F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("bigint") - 1
    form = F.when(g % 3 == 0, "stream").when(g % 3 == 1, "ring").otherwise("other")
    rows = keys.withColumn("i", at).select(
        "g", form.alias("format"), F.when(g % 3 == 0, "source_bytes").otherwise("sequence").alias("domain"), (F.col("i") * 10 + F.when(g % 3 == 0, 0).otherwise(1)).alias("lo"),
        (F.col("i") * 10 + F.when(F.pmod(k, F.lit(151)) == 0, 5).otherwise(10)).alias("hi"), F.when(F.pmod(k, F.lit(211)) == 0, "lost").otherwise("retained").alias("cause"),
    )
    artifacts = rows.groupBy("g", "format").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    return ranges.completeness_status(rows, artifacts, ["g"])


@query("SELECT tid, bool_and(etype <> 'error') AS provider_complete, bool_and(etype <> 'error' AND etype <> 'signup' AND k > 0) AS complete FROM ev GROUP BY tid")
def a15_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf)
    flag = lambda c: F.when(c, 1).otherwise(0)
    facts = rows.select("tid", F.lit(0).alias("n_missing"), flag(F.col("etype") == "error").alias("n_damage"), flag(F.col("etype") == "signup").alias("n_open"), (F.col("k") > 0).alias("terminal"))
    return ranges.verdicts(facts, ["tid"])


@query("SELECT r, CASE WHEN k % 5 = 0 THEN 'checksum' WHEN k % 3 = 0 OR r % 7 = 0 OR r % 11 = 0 OR k % 13 = 0 OR r % 17 = 0 THEN 'lost' ELSE 'overwritten' END AS cause, k % 5 <> 0 AND k % 3 <> 0 AS overwritten_sequences FROM ev")
def a16_classify_missing(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda c, n: F.pmod(c, F.lit(n)) == 0
    flags = {"damaged": said("k", 5), "covered": said("k", 3), "flagged": said("r", 7), "incomplete": said("r", 11), "stale": said("k", 13), "unterminated": said("r", 17)}
    gaps = views.log(spark, sf).select("r", *[c.alias(n) for n, c in flags.items()])
    return ranges.classify_missing(gaps).select("r", "cause", "overwritten_sequences")


_COUNTERS_SQL = """WITH c AS (SELECT l_suppkey AS run, sum(l_quantity)::HUGEINT AS instructions, sum(l_linenumber)::HUGEINT % 7 AS elapsed_ms, sum(l_partkey)::HUGEINT AS encoded_bytes,
  sum(l_orderkey)::HUGEINT AS compressed_bytes, count(*) FILTER (l_returnflag = 'R') AS cache_hits, count(*) FILTER (l_returnflag = 'N') AS cache_misses FROM lineitem GROUP BY 1)
"""


def _counters(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.sum("l_quantity").cast("bigint").alias("instructions"), F.pmod(F.sum("l_linenumber"), F.lit(7)).alias("elapsed_ms"), F.sum("l_partkey").alias("encoded_bytes"),
        F.sum("l_orderkey").alias("compressed_bytes"), F.count_if(F.col("l_returnflag") == "R").alias("cache_hits"), F.count_if(F.col("l_returnflag") == "N").alias("cache_misses"),
    )


def _cut(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN '0.000000' ELSE (({n}) // {d})::VARCHAR || '.' || lpad(((({n}) % {d}) * 1000000 // nullif({d}, 0))::VARCHAR, 6, '0') END"


@query(_COUNTERS_SQL + f"""SELECT run, {_cut('instructions * 1000', 'elapsed_ms')} AS instructions_per_second, {_cut('encoded_bytes * 1000', 'elapsed_ms')} AS encoded_bytes_per_second,
  {_cut('compressed_bytes', 'encoded_bytes')} AS compression_ratio, {_cut('cache_hits', '(cache_hits + cache_misses)')} AS cache_hit_rate FROM c""", view=False)
def a17_truncated_rates(spark: SparkSession, sf: str) -> DataFrame:
    names = ("instructions_per_second", "encoded_bytes_per_second", "compression_ratio", "cache_hit_rate")
    return metrics.rates(_counters(spark, sf)).select("run", *[F.col(n).cast("string").alias(n) for n in names])


@query("SELECT p_brand, median(p_size)::DOUBLE AS middle FROM part GROUP BY p_brand", view=False)
def a18_exact_median(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "part").groupBy("p_brand").agg(metrics.median(F.col("p_size")).alias("middle"))


@query("SELECT l_returnflag, l_linestatus, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY ALL", view=False)
def a19_nearest_rank_p95(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(metrics.nearest_rank("l_quantity", 0.95).alias("p95"))


@query("SELECT r_regionkey, min(n_regionkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", view=False)
def a20_constant(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "nation").join(views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_regionkey").agg(metrics.constant("n_regionkey", "the region").alias("value"))


@query("""SELECT r, CASE WHEN k > 50 AND k <= 100 THEN 'producer_wait_time' ELSE 'undetermined' END AS dominant FROM ev""")
def a21_diagnose(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).select("r", F.lit(100).alias("elapsed_ms"), (F.when(F.col("k") <= 100, F.col("k")).otherwise(0) * 1_000_000).alias("producer_wait_ns"), (100 - F.pmod("r", F.lit(100))).alias("cache_hits"), F.pmod("r", F.lit(100)).alias("cache_misses"))
    return metrics.diagnose(rows).select("r", "dominant")


@query("""WITH b AS (SELECT l_returnflag AS g, median(l_quantity) AS baseline_ms FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
c AS (SELECT l_returnflag AS g, median(l_quantity) AS current_ms FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT g, baseline_ms, current_ms, baseline_ms / current_ms AS speedup, baseline_ms / current_ms >= 1 AS passed FROM b JOIN c USING (g)""", view=False)
def a22_speedups(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("elapsed_ms"), "l_linestatus")
    return metrics.speedups(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), ["g"]).select("g", "baseline_ms", "current_ms", "speedup", "passed")


@query("""SELECT tid, count(*) AS n, arg_min(t, r) AS first, arg_max(t, r) AS last FROM (SELECT tid, r, r || ' lib' || (tid % 4) || '+0x' || lower(to_hex(k * 4)) || ' ' || mnemonic AS t FROM ev WHERE etype <> 'error') GROUP BY tid""")
def a23_run_oracle(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    rows = t.instructions.join(t.definitions, ["artifact", "definition"]).join(t.modules.select("artifact", "module", F.col("name").alias("module_name")), ["artifact", "module"])
    rows = rows.join(t.events.select("artifact", F.col("source_row").alias("owner_row"), "tid", "sequence"), ["artifact", "owner_row"])
    return metrics.run_oracle(rows.drop("module").withColumnRenamed("module_name", "module"), ["tid"])


# Memory, registers, calls.
def _thread_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Each thread's last event as a target."""
    return views.trace(spark, sf).events.groupBy("artifact", "timeline", "tid").agg(F.max("source_row").alias("row")).withColumn("target", F.col("tid"))


_MEMORY_SQL = """, t AS (SELECT tid AS target, tid, max(r) AS row FROM ev GROUP BY tid), a AS (SELECT unnest(range(0, 256)) AS address),
cells AS (SELECT target, tid, row, address FROM t, a),
w AS (SELECT c.target, c.address, max(e.r) AS wr FROM cells c JOIN ev e ON e.etype = 'purchase' AND e.r % 5 <> 1 AND e.r < c.row AND c.address >= e.k * 8 AND c.address < e.k * 8 + 1 + e.r % 16 GROUP BY 1, 2),
d AS (SELECT c.target, c.address, max(CASE WHEN e.r % 2 = 1 THEN e.r END) AS da, max(CASE WHEN e.r % 2 = 0 THEN e.r END) AS dt FROM cells c JOIN ev e ON e.etype = 'error' AND e.r <= c.row
  AND (e.r % 2 = 1 OR e.tid = c.tid) AND (e.k % 2 = 1 OR c.address >= e.k * 8 AND c.address < e.k * 8 + 16) GROUP BY 1, 2),
x AS (SELECT c.target, c.address, wr, we.tid AS wtid, c.tid, da, dt FROM cells c LEFT JOIN w USING (target, address) LEFT JOIN d USING (target, address) LEFT JOIN ev we ON we.r = wr),
y AS (SELECT *, CASE WHEN wr IS NULL THEN da IS NOT NULL OR dt IS NOT NULL ELSE coalesce(da > wr, FALSE) OR coalesce(dt > wr AND wtid = tid, FALSE) END AS hidden FROM x)
SELECT target, address, CASE WHEN NOT hidden AND wr % 5 <> 0 THEN wr % 256 END::INT AS value,
  CASE WHEN hidden OR wr % 5 = 0 THEN 'damaged' WHEN wr IS NOT NULL THEN 'derived' ELSE 'unknown' END AS provenance, CASE WHEN NOT hidden THEN wr END AS evidence FROM y"""


@query(_MEMORY_SQL)
def m1_memory_state(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    targets = _thread_ends(spark, sf).select("artifact", "timeline", "target", "row", "tid", F.lit(0).cast("bigint").alias("lo"), F.lit(256).cast("bigint").alias("hi"))
    cells = memory.state_at(targets, t.memory, t.discontinuities)
    return cells.select("target", "address", "last_written.*")


@query("""SELECT t.tid AS target, e.r AS row, e.tid, e.k * 8 AS address, 1 + e.r % 16 AS size, CASE e.etype WHEN 'view' THEN 'read' ELSE 'write' END AS direction
  FROM (SELECT tid, max(r) AS row FROM ev GROUP BY tid) t JOIN ev e ON e.etype IN ('view', 'purchase') AND e.r <= t.row AND e.k * 8 < 20 AND e.k * 8 + 1 + e.r % 16 > 4""")
def m2_memory_history(spark: SparkSession, sf: str) -> DataFrame:
    targets = _thread_ends(spark, sf).select("artifact", "timeline", "target", "row", "tid", F.lit(4).cast("bigint").alias("lo"), F.lit(20).cast("bigint").alias("hi"))
    return memory.history(targets, views.trace(spark, sf).memory, 1_000_000)


@query("SELECT r AS row, CASE WHEN etype = 'view' OR r % 5 = 1 THEN '<not-captured>' WHEN r % 5 = 0 THEN '<unavailable>' ELSE repeat(lpad(lower(to_hex(r % 256)), 2, '0'), (1 + r % 16)::INT) END AS after FROM ev WHERE etype IN ('view', 'purchase')")
def m3_capture_states(spark: SparkSession, sf: str) -> DataFrame:
    return views.trace(spark, sf).memory.select("row", memory.capture_state(F.col("after.bytes"), F.col("after.state")).alias("after"))


@query(_MEMORY_SQL.replace("e.r % 5 <> 1 AND e.r < c.row", "e.r % 5 <> 1 AND e.tid = c.tid AND e.r < c.row").replace("\ny AS", "\no AS (SELECT DISTINCT c.target, c.address, TRUE AS other FROM cells c JOIN ev e ON e.etype = 'purchase' AND e.tid <> c.tid AND c.address >= e.k * 8 AND c.address < e.k * 8 + 1 + e.r % 16),\ny AS").replace("ELSE coalesce(da > wr, FALSE) OR coalesce(dt > wr AND wtid = tid, FALSE) END AS hidden FROM x", "ELSE coalesce(da > wr, FALSE) OR coalesce(dt > wr AND wtid = tid, FALSE) END OR coalesce(other, FALSE) AS hidden FROM x LEFT JOIN o USING (target, address)"))
def m4_unordered_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    targets = _thread_ends(spark, sf).select("artifact", "timeline", "target", "row", "tid", F.lit(0).cast("bigint").alias("lo"), F.lit(256).cast("bigint").alias("hi"))
    return memory.state_at(targets, t.memory, t.discontinuities, global_ordering=False).select("target", "address", "last_written.*")


@query(""", t AS (SELECT tid, max(r) AS row FROM ev GROUP BY tid), s AS (SELECT unnest(range(0, 34)) AS slot),
o AS (SELECT t.tid, s.slot, row, max(e.r) FILTER (e.r < row OR e.etype = 'click') AS rb, max(e.r) AS ra FROM t, s LEFT JOIN ev e ON e.tid = t.tid AND e.etype IN ('click', 'purchase') AND e.k % 34 = s.slot GROUP BY ALL),
b AS (SELECT t.tid, max(e.r) AS broken FROM t LEFT JOIN ev e ON e.etype = 'error' AND e.k % 2 = 1 AND e.r <= t.row AND (e.r % 2 = 1 OR e.tid = t.tid) GROUP BY 1),
c AS (SELECT tid, slot, row, 'before' AS side, rb AS h FROM o UNION ALL SELECT tid, slot, row, 'after', ra FROM o),
v AS (SELECT c.tid, slot, side, row, CASE WHEN h IS NOT NULL AND NOT coalesce(broken > h, FALSE) THEN h END AS h FROM c JOIN b USING (tid))
SELECT tid, slot::INT AS slot, side, h AS value, CASE WHEN h IS NULL THEN 'unknown' WHEN h = (SELECT max(e.r) FROM ev e WHERE e.tid = v.tid AND e.etype <> 'view' AND e.etype <> 'signup') THEN 'captured' ELSE 'derived' END AS provenance FROM v""")
def r1_register_states(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    targets = _thread_ends(spark, sf)
    broken = registers.invalidations(t.discontinuities, t.register_obs)
    replay = views.log(spark, sf).where("etype IN ('click', 'purchase', 'error')").select(F.lit("a").alias("artifact"), F.lit(0).cast("bigint").alias("timeline"), "tid", F.col("r").alias("row"))
    return registers.states_at(targets, t.register_obs, broken, replay).select("tid", "slot", "side", "value", "provenance")


@query("SELECT 'a' AS artifact, r // 34 AS owner_row FROM ev GROUP BY 2 HAVING count(*) = 34")
def r2_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.log(spark, sf).select(F.lit("a").alias("artifact"), F.floor(F.col("r") / 34).alias("owner_row"), F.pmod("r", F.lit(34)).cast("int").alias("slot"), F.lit("checkpoint").alias("access"))
    return registers.checkpoint_rows(rows)


@query("SELECT DISTINCT r AS source_row FROM ev WHERE etype IN ('click', 'purchase') AND k % 34 = 5")
def r3_rows_observing_register(spark: SparkSession, sf: str) -> DataFrame:
    return access.rows_observing_register(views.trace(spark, sf), 5).select("source_row")


@query(""", s AS (SELECT *, sum(CASE WHEN etype = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY r) AS sec FROM ev)
SELECT r AS row, lead(k * 4) OVER (PARTITION BY tid, sec ORDER BY r) AS next_pc FROM s WHERE etype <> 'error'""")
def c1_next_pc(spark: SparkSession, sf: str) -> DataFrame:
    return calltree.next_pcs(views.steps(spark, sf)).where("kind = 'instruction'").select("row", "next_pc")


@query()
def c2_call_tree(spark: SparkSession, sf: str) -> DataFrame:
    return calltree.build(views.steps(spark, sf))


@query("SELECT r AS row, sum(CASE etype WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY r)::BIGINT AS depth FROM ev")
def c2_call_depth(spark: SparkSession, sf: str) -> DataFrame:
    return calltree.depth(views.steps(spark, sf)).select("row", "depth")


@query("SELECT r AS source_row, 'call' AS what FROM ev WHERE etype = 'signup' UNION ALL SELECT r, 'return' FROM ev WHERE etype = 'purchase'")
def c3_call_and_return_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return access.call_rows(t).select("source_row", F.lit("call").alias("what")).unionByName(access.return_rows(t).select("source_row", F.lit("return").alias("what")))


@query()
def c4_children_page(spark: SparkSession, sf: str) -> DataFrame:
    first = views.log(spark, sf).agg(F.min("tid")).first()[0]
    return calltree.children_page(calltree.build(views.steps(spark, sf).where(F.col("tid") == first)), None)


@query("SELECT r, coalesce(last_value(CASE WHEN etype = 'click' THEN k % 3 = 0 END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY r), FALSE) AS in_effect FROM ev")
def w1_policy_in_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks are policy rules; one in three has the wanted text, the others switch it off."""
    return pairing.policy_in_effect(views.log(spark, sf), F.col("etype") == "click", F.pmod("k", F.lit(3)) == 0, "tid", "r").select("r", "in_effect")


@query("SELECT tid, entry, greatest(0, (SELECT count(*) FROM sc) - 256) AS omitted FROM sc ORDER BY entry DESC LIMIT 256")
def w2_newest_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.newest(views.scenes(spark, sf).select("tid", "entry"), "entry")


@query("SELECT tid, (k % 34)::INT AS slot, max(r) AS value FROM ev WHERE etype IN ('click', 'purchase') GROUP BY 1, 2")
def w3_latest_registers(spark: SparkSession, sf: str) -> DataFrame:
    return registers.latest_states(views.trace(spark, sf).register_obs).select("tid", "slot", "value")


@query("""WITH g AS (SELECT cause, hi AS upto FROM (SELECT o_orderstatus AS cause, max(o_orderkey + o_custkey % 5) AS hi FROM orders WHERE o_orderkey <= 500 GROUP BY 1)),
s AS (SELECT event_id AS entry FROM events WHERE event_type = 'signup')
SELECT entry, coalesce((SELECT string_agg(cause, ',' ORDER BY cause) FROM g WHERE upto >= entry), '') AS reasons,
  CASE WHEN EXISTS (SELECT 1 FROM g WHERE upto >= entry) THEN 'uncertain' ELSE 'observed' END AS membership FROM s""", view=False)
def scene_at_membership(spark: SparkSession, sf: str) -> DataFrame:
    gaps = _order_ranges(spark, sf).withColumnRenamed("cause", "reason")
    return pairing.membership(views.scenes(spark, sf).select("entry"), gaps, 500).select("entry", F.array_join("reasons", ",").alias("reasons"), "membership")


# Row lookups.
def _lookup(name: str, run: Callable, where: str) -> None:
    def found(spark: SparkSession, sf: str) -> DataFrame:
        return run(views.trace(spark, sf)).select("source_row")

    found.__name__ = name
    query(f"SELECT r AS source_row FROM ev WHERE {where}")(found)


_lookup("x1_timeline", lambda t: access.rows_for_timeline(t, 0), "TRUE")
_lookup("x2_tids", lambda t: access.rows_for_tids(t, [1, 2]), "tid IN (1, 2)")
_lookup("x3_sequence_range", lambda t: access.rows_for_sequence_range(t, 100, 900), "r >= 100 AND r < 900")
_lookup("x4_kinds", lambda t: access.rows_of_kinds(t, ["memory"]), "kind = 'memory'")
_lookup("x5_modules", lambda t: access.rows_for_modules(t, [2]), "etype <> 'error' AND tid % 4 = 2")
_lookup("x6_module_pc_range", lambda t: access.rows_for_module_pc_range(t, 1, 40, 200), "etype <> 'error' AND tid % 4 = 1 AND k * 4 >= 40 AND k * 4 < 200")
_lookup("x7_definitions", lambda t: access.rows_for_definitions(t, [0, 3]), "etype IN ('signup', 'click')")
_lookup("x8_observed_register", lambda t: access.rows_observing_register(t, 7), "etype IN ('click', 'purchase') AND k % 34 = 7")
_lookup("x10_calls", access.call_rows, "etype = 'signup'")
_lookup("x10_returns", access.return_rows, "etype = 'purchase'")
_lookup("x11_categories", lambda t: access.rows_for_categories(t, ["click"]), "etype = 'click'")
_lookup("x11_names", lambda t: access.rows_for_names(t, ["n1"]), "kind LIKE 'semantic%' AND k % 10 = 1")
_lookup("x12_memory_overlaps", lambda t: access.memory_overlaps(t, 64, 96), "etype IN ('view', 'purchase') AND k * 8 < 96 AND k * 8 + 1 + r % 16 > 64")


@query("SELECT r AS sequence, r AS source_row FROM ev")
def x13_row_for_key(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    keys = t.events.select("artifact", "timeline", "record_ordinal", "source_offset", "sequence", "tid")
    return access.row_for_key(t, keys).select("sequence", "source_row")


@query("SELECT 'a' AS artifact, r AS source_row FROM ev WHERE etype = 'signup'")
def x14_bounded_rows(spark: SparkSession, sf: str) -> DataFrame:
    return access.bounded_rows(access.call_rows(views.trace(spark, sf)), 10_000_000)


@query("SELECT o_orderstatus AS cause, o_orderkey AS lo, o_orderkey + o_custkey % 5 AS hi FROM orders", view=False)
def x15_completeness_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_ranges(spark, sf).withColumn("artifact", F.lit("a")).withColumn("domain", F.lit("sequence"))
    return access.completeness_listing(rows).select("cause", "lo", "hi")


@query("SELECT k * 8 AS address, CASE WHEN k * 8 < 200 THEN 0 WHEN k * 8 >= 400 THEN 1 END::BIGINT AS module, CASE WHEN k * 8 < 200 THEN k * 8 WHEN k * 8 >= 400 THEN k * 8 - 400 END AS offset FROM ev")
def y1_module_of_address(spark: SparkSession, sf: str) -> DataFrame:
    maps = spark.createDataFrame([(0, 0, 200), (1, 400, 1 << 40)], "module bigint, base bigint, size bigint")
    maps = maps.withColumn("size", F.least("size", F.lit(1 << 20)))
    return access.module_of(views.log(spark, sf).select((F.col("k") * 8).alias("address")), maps)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber DESC) AS n FROM lineitem) WHERE n <= 5", view=False)
def y6_newest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return pairing.newest(rows, "at", 5, ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'a' AS artifact, r // 34 AS source_row FROM ev GROUP BY 2")
def x9_checkpoint_owners(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    rows = t.events.select("artifact", F.floor(F.col("source_row") / 34).alias("owner_row"), F.lit("checkpoint").alias("access"))
    return access.checkpoint_owner_rows(replace(t, register_obs=rows))


@query("SELECT r AS source_row FROM ev WHERE kind = 'memory' AND NOT (etype = 'view' AND tid IN (1, 2, 3))")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trace(spark, sf)
    return access.without_rows(access.rows_of_kinds(t, ["memory"]), access.rows_for_tids(t, [1, 2, 3])).select("source_row")


@query("SELECT (SELECT count(*) FROM ev) AS facts, TRUE AS same")
def y3_same_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes over the source agree: nothing is left of either when the other is taken away."""
    one, two = (views.trace(spark, sf).events for _ in range(2))
    left = one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count("*").alias("odd"))
    return one.agg(F.count("*").alias("facts")).join(F.broadcast(left)).select("facts", (F.col("odd") == 0).alias("same"))  # one row each


# Incremental.
def _streamed(rows: DataFrame) -> DataFrame:
    """What a stream gives once all files are read, through the file sink."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_end(spark, at)
    incremental.partial_scan(rows, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.stream_events(spark, sf, views.table(spark, sf, "events").schema, pattern="events.parquet")


@query("SELECT r AS event_id, tid AS user_id, etype AS event_type FROM ev WHERE etype IN ('view', 'error') AND contains(props, '7')")
def t1_partial_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _event_stream(spark, sf).where(F.col("event_type").isin("view", "error") & F.col("props").contains("7"))
    return _streamed(rows.select("event_id", "user_id", "event_type"))


@query(", " + _BOUNDS_SQL + """SELECT x.tid, x.id, CASE WHEN e.seq < x.seq THEN e.seq END AS entry, x.seq AS ending,
  CASE WHEN e.seq IS NULL OR e.seq > x.seq THEN 'orphan' WHEN e.address = x.address THEN 'returned' ELSE 'invalid' END AS state
  FROM (SELECT * FROM b WHERE etype = 'purchase') x LEFT JOIN (SELECT * FROM b WHERE etype = 'signup') e ON e.tid = x.tid AND e.id = x.id""")
def t5_streamed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered boundaries as a stream; a return that comes before its enter is an orphan when it comes."""
    rows = _boundaries(spark, sf).select("tid", "id", "seq", "phase", F.col("address").cast("bigint").alias("address"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.coalesce(1).sortWithinPartitions("seq").write.parquet(at)
    delete_at_end(spark, at)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _streamed(incremental.pair_stream(incremental.stream_events(spark, at, rows.schema)))


# Scalars.
@query("""SELECT r, bit_count(k)::INT AS bits, CASE WHEN k - 50 BETWEEN -4095 AND -1 THEN 50 - k END AS error, (r * 4097 // 4096 * 4096)::BIGINT AS page,
  (r % 256)::BIGINT AS low_byte, lpad(lower(to_hex(r % 256)), 2, '0') || lpad(lower(to_hex(r // 256 % 256)), 2, '0') AS little_endian, to_json(props)::VARCHAR AS quoted FROM ev""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    r, k = F.col("r"), F.col("k")
    return views.log(spark, sf).select(
        "r", scalars.popcount(k).alias("bits"), scalars.errno(k - 50).alias("error"), u64.page_base(r * 4097).alias("page"), scalars.truncate_value(r, F.lit(1)).alias("low_byte"),
        F.lower(F.hex(scalars.little_endian(r, F.lit(2)))).alias("little_endian"), scalars.json_quote(F.col("props")).alias("quoted"),
    )
