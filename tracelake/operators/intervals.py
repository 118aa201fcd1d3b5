"""Interval joins.  Both sides are cut into buckets and joined on the bucket, so no join is a cross join.

Buckets have widths of a power of two.  A long interval goes to wider buckets (each level
is four times as wide), so it is one or two rows at its level however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_LEVEL = 31
#: Of ``overlap_join_until``: right rows of a part, left rows of a group.
PART_ROWS, GROUP_ROWS = 1024, 1 << 14


def bucket(c: Column, width: int) -> Column:
    """The number of the bucket of ``width`` (rounded up to a power of two) that holds a long."""
    return F.shiftright(c.cast("bigint"), (width - 1).bit_length())


def _at_level(c: Column, level: Column, width: int) -> Column:
    bits = F.least(F.lit(63), level * 2 + (width - 1).bit_length())
    return F.call_function("shiftright", c.cast("bigint"), bits.cast("int"))


def _level(first: Column, last: Column, width: int) -> Column:
    """The least level at which an interval spans two buckets or so."""
    length = (last.cast("double") - first.cast("double") + 1) / width
    return F.least(F.lit(TOP_LEVEL), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0))) / 2))).cast("int")


def _present(rows: DataFrame, name: str) -> list[int]:
    """The levels in use: at most ``TOP_LEVEL`` + 1 numbers."""
    return sorted(r[0] for r in rows.select(name).distinct().collect())


def levels_of(left: DataFrame, right: DataFrame, width: int, lspan: tuple[str, str], rspan: tuple[str, str]) -> tuple[list[int], int]:
    """The levels at which intervals of two sides are joined, and the number of left ones."""
    sides = [rows.where(F.col(x) < F.col(y)).select(_level(F.col(x), F.col(y) - 1, width).alias("__l"), F.lit(own).alias("__own")) for rows, (x, y), own in ((left, lspan, True), (right, rspan, False))]
    found = sides[0].unionByName(sides[1]).groupBy("__l").agg(F.count_if("__own")).collect()
    return sorted(r[0] for r in found), sum(r[1] for r in found)


def _spread(rows: DataFrame, first: Column, last: Column, own: Column, levels: list[int], width: int) -> DataFrame:
    """A row for each given level from its own upwards and each bucket there."""
    wanted = F.filter(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"), lambda x: x >= own)
    rows = rows.withColumn("__level", F.explode(wanted))
    level = F.col("__level")
    return rows.withColumn("__bucket", F.explode(F.sequence(_at_level(first, level, width), _at_level(last, level, width))))


def _meeting(pairs: DataFrame, lspan: tuple[str, str], rspan: tuple[str, str], width: int) -> DataFrame:
    """Of pairs that share a bucket those that overlap, in the bucket of the overlap's start at the longer one's level."""
    (ls, le), (rs, re) = lspan, rspan
    meet = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("__level") == F.greatest("__la", "__lb"))
    start = _at_level(F.greatest(F.col(ls), F.col(rs)), F.col("__level"), width)
    return pairs.where(meet & (start == F.col("__bucket"))).drop("__bucket", "__level", "__la", "__lb")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, lspan: tuple[str, str], rspan: tuple[str, str]) -> DataFrame:
    """Pairs of half-open intervals that overlap, once each; empty intervals overlap nothing.

    Two intervals meet at the level of the longer one.  A pair that shares several
    buckets is kept in the bucket of its overlap's start alone, so nothing has to be
    made distinct.
    """
    (ls, le), (rs, re) = lspan, rspan
    a = left.where(F.col(ls) < F.col(le)).withColumn("__la", _level(F.col(ls), F.col(le) - 1, width))
    b = right.where(F.col(rs) < F.col(re)).withColumn("__lb", _level(F.col(rs), F.col(re) - 1, width))
    levels = sorted({*_present(a, "__la"), *_present(b, "__lb")})
    a = _spread(a, F.col(ls), F.col(le) - 1, F.col("__la"), levels, width)
    b = _spread(b, F.col(rs), F.col(re) - 1, F.col("__lb"), levels, width)
    return _meeting(a.join(b, [*on, "__level", "__bucket"]), lspan, rspan, width)


def overlap_join_until(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, lspan: tuple[str, str], rspan: tuple[str, str], until: str, at: str, levels: list[int], tasks: int | None = None) -> DataFrame:
    """Pairs of ``overlap_join`` whose ``at`` (right) is not after ``until`` (left), with no shuffle of pairs.

    A bucket's right rows are cut in the order of ``at`` into parts of about ``PART_ROWS``, and its left rows are dealt
    out in groups of about ``GROUP_ROWS``; a left row goes to the parts that begin by its ``until``.  So the pairs of a
    full bucket are made by many tasks, and what is shuffled grows with the pairs by a ``PART_ROWS``th only.
    ``levels``: what ``levels_of`` gives for these sides.  ``tasks``: of the last join; else Spark chooses by the bytes
    shuffled, which say little of the pairs.
    """
    (ls, le), (rs, re) = lspan, rspan
    a = left.where(F.col(ls) < F.col(le)).withColumn("__la", _level(F.col(ls), F.col(le) - 1, width))
    b = right.where(F.col(rs) < F.col(re)).withColumn("__lb", _level(F.col(rs), F.col(re) - 1, width))
    a = _spread(a, F.col(ls), F.col(le) - 1, F.col("__la"), levels, width)
    b = _spread(b, F.col(rs), F.col(re) - 1, F.col("__lb"), levels, width).withColumn("__run", bucket(F.col(at), PART_ROWS))
    place = [*on, "__level", "__bucket"]
    asked = a.groupBy(*place).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("__groups"))
    runs = b.groupBy(*place, "__run").agg(F.count("*").alias("__n"), F.min(at).alias("__from")).join(asked, place)
    before = Window.partitionBy(*place).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__part", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / PART_ROWS))
    parts = runs.groupBy(*place, "__part").agg(F.min("__from").alias("__from"), F.first("__groups").alias("__groups"))
    a = a.join(parts, place).where(F.col("__from") <= F.col(until))
    a = a.withColumn("__group", F.pmod(F.xxhash64(*left.columns), F.col("__groups"))).drop("__from", "__groups")
    b = b.join(runs.select(*place, "__run", "__part", "__groups"), [*place, "__run"])
    b = b.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__groups") - 1))).drop("__run", "__groups")
    # One column, so that a constant among the keys (a view's artifact) doesn't make Spark deal the rows out once more.
    cell = F.struct(*place, "__part", "__group").alias("__cell")
    a, b = a.select("*", cell).drop("__part", "__group"), b.select("*", cell).drop(*place, "__part", "__group")
    if tasks:
        a, b = a.repartition(tasks, "__cell"), b.repartition(tasks, "__cell")
    pairs = a.join(b, "__cell").where(F.col(at) <= F.col(until))
    return _meeting(pairs, lspan, rspan, width).drop("__cell")


def points_in_intervals(points: DataFrame, spans: DataFrame, on: Sequence[str], width: int, point: str, span: tuple[str, str]) -> DataFrame:
    """Pairs of a point and an inclusive span [entry, last] that holds it."""
    entry, last = span
    b = spans.where(F.col(entry) <= F.col(last)).withColumn("__lb", _level(F.col(entry), F.col(last), width))
    levels = _present(b, "__lb")
    at = F.col(point)
    a = _spread(points, at, at, F.lit(0), levels, width)
    level = F.col("__level")
    b = b.withColumn("__level", F.col("__lb")).withColumn("__bucket", F.explode(F.sequence(_at_level(F.col(entry), level, width), _at_level(F.col(last), level, width))))
    return a.join(b, [*on, "__level", "__bucket"]).where((F.col(entry) <= at) & (at <= F.col(last))).drop("__bucket", "__level", "__lb")


def innermost(points: DataFrame, spans: DataFrame, on: Sequence[str], width: int, point: str, span: tuple[str, str], key: Sequence[str], value: str) -> DataFrame:
    """(key.., value): for each point the holding span with the greatest entry (ties: the greater value)."""
    found = points_in_intervals(points, spans, on, width, point, span)
    return found.groupBy(*key).agg(F.max(F.struct(F.col(span[0]).alias("entry"), F.col(value).alias("value"))).alias("best")).select(*key, F.col("best.value").alias(value))


def carry_forward(points: DataFrame, marks: DataFrame, keys: Sequence[str], values: Sequence[str], width: int = 1 << 16) -> DataFrame:
    """``points`` (keys.., at, sub, ..) with each of ``values``: the last that isn't null among marks at or before the point.

    ``marks`` has keys.., at, sub and the values.  ``sub`` orders rows of one ``at``; of
    equals the point comes last.  Rows are put in order within buckets of ``width``
    places, and each bucket's last values are then carried over the buckets, so a
    key's rows need not meet in one task.  The plan holds ``points`` twice: carry
    several values at once rather than one after the other.
    """
    own = F.struct(*points.columns).alias("__point")
    empty = [F.lit(None).cast(marks.schema[v].dataType).alias(v) for v in values]
    rows = (
        points.select(*keys, "at", "sub", *empty, own)
        .unionByName(marks.select(*keys, "at", "sub", *values), allowMissingColumns=True)
        .withColumn("__b", bucket(F.col("at"), width))
        .withColumn("__is", F.col("__point").isNotNull())
    )
    order = Window.partitionBy(*keys, "__b").orderBy("at", "sub", "__is").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({f"__near_{v}": F.last(v, ignorenulls=True).over(order) for v in values}).where("__is")
    when = F.struct("at", "sub")
    ends = marks.withColumn("__b", bucket(F.col("at"), width)).groupBy(*keys, "__b").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), when)).alias(f"__end_{v}") for v in values]
    )
    asked = points.select(*keys, bucket(F.col("at"), width).alias("__b")).distinct()
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    far = [F.last(f"__end_{v}", ignorenulls=True).over(across).alias(f"__far_{v}") for v in values]
    carried = ends.join(asked, [*keys, "__b"], "full_outer").select(*keys, "__b", *far)
    found = seen.join(carried, [*keys, "__b"], "left")
    return found.select("__point.*", *[F.coalesce(f"__near_{v}", f"__far_{v}").alias(v) for v in values])


def carry_rows(rows: DataFrame, keys: Sequence[str], at: str, values: dict[str, Column], width: int = 1 << 16, back: bool = False, strict: bool = False) -> DataFrame:
    """``rows`` with each of ``values``: the last that isn't null among the key's rows up to each row, before it with ``strict``.

    With ``back`` the first one at or after it.  Places are unique within a key.  Rows are put in
    order within buckets of ``width`` places, and one row for each bucket carries on, so that no
    task holds a whole key.  Keys aren't null.
    """
    turned = (lambda c: F.col(c).desc()) if back else F.col
    marked = rows.withColumns({f"__of_{n}": v for n, v in values.items()}).withColumn("__b", bucket(F.col(at), width))
    near = Window.partitionBy(*keys, "__b").orderBy(turned(at)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    edge = F.min_by if back else F.max_by
    ends = marked.groupBy(*keys, "__b").agg(*[edge(f"__of_{n}", F.when(F.col(f"__of_{n}").isNotNull(), F.col(at))).alias(f"__end_{n}") for n in values])
    across = Window.partitionBy(*keys).orderBy(turned("__b")).rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select(*keys, "__b", *[F.last(f"__end_{n}", ignorenulls=True).over(across).alias(f"__far_{n}") for n in values])
    seen = marked.withColumns({f"__near_{n}": F.last(f"__of_{n}", ignorenulls=True).over(near) for n in values})
    return seen.join(far, [*keys, "__b"], "left").select(*rows.columns, *[F.coalesce(f"__near_{n}", f"__far_{n}").alias(n) for n in values])


def running_sum(rows: DataFrame, keys: Sequence[str], at: str, step: Column, name: str, sub: str | None = None, width: int = 1 << 16) -> DataFrame:
    """``rows`` with ``name``: the sum of ``step`` over the key's rows up to each, in order of ``at`` and ``sub``; in buckets like ``carry_rows``."""
    marked = rows.withColumn("__step", step).withColumn("__b", bucket(F.col(at), width))
    near = Window.partitionBy(*keys, "__b").orderBy(at, *([sub] if sub else [])).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy(*keys, "__b").agg(F.sum("__step").alias("__end")).select(*keys, "__b", F.sum("__end").over(across).alias("__far"))
    seen = marked.withColumn("__near", F.sum("__step").over(near)).join(ends, [*keys, "__b"], "left")
    return seen.select(*rows.columns, (F.col("__near") + F.coalesce("__far", F.lit(0))).cast("bigint").alias(name))


def stabbing(spans: DataFrame, at: int, n: int, span: tuple[str, str], tid: int | None = None) -> DataFrame:
    """The ``n`` spans that hold ``at``, innermost (greatest entry) first, with ``has_more``."""
    entry, last = span
    rows = spans.where((F.col(entry) <= at) & (F.col(last) >= at))
    rows = rows if tid is None else rows.where(F.col("tid") == tid)
    top = rows.orderBy(F.col(entry).desc()).limit(n + 1)
    ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(F.col(entry).desc())))  # n + 1 rows
    return ranked.withColumn("has_more", F.max("__r").over(Window.partitionBy(F.lit(0))) > n).where(F.col("__r") <= n).drop("__r")


def resolve_symbols(pcs: DataFrame, symbols: DataFrame, on: Sequence[str], width: int = 4096) -> DataFrame:
    """``pcs`` (on.., pc) with symbol, symbol_address and offset.

    The rightmost symbol that contains the pc wins, then the nearest before it.
    Containment is a bucketed join; the fallback is an as-of: symbols and pcs are
    put in one order and the last symbol seen is carried on, first within buckets
    and then from bucket to bucket, so that no task holds a whole module.
    """
    wanted = pcs.select(*on, "pc").distinct()
    table = symbols.select(*on, F.col("address").alias("symbol_address"), F.col("size").alias("symbol_size"), F.col("name").alias("symbol"))
    table = table.withColumn("symbol_end", F.col("symbol_address") + F.col("symbol_size"))
    spans = table.where("symbol_size > 0").withColumn("symbol_last", F.col("symbol_end") - 1)
    inside = points_in_intervals(wanted, spans, on, width, "pc", ("symbol_address", "symbol_last"))
    best = inside.groupBy(*on, "pc").agg(F.max(F.struct("symbol_address", "symbol")).alias("held"))
    before = _last_before(wanted, table, on, width)
    joined = wanted.join(best, [*on, "pc"], "left").join(before, [*on, "pc"], "left")
    chosen = F.coalesce("held", "near")
    found = joined.select(*on, "pc", chosen["symbol"].alias("symbol"), chosen["symbol_address"].alias("symbol_address"))
    found = found.withColumn("symbol_offset", F.col("pc") - F.col("symbol_address"))
    return pcs.join(found, [*on, "pc"], "left")


def _last_before(points: DataFrame, table: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    marks = table.select(*on, F.col("symbol_address").alias("at"), F.struct("symbol_address", "symbol").alias("s"), F.lit(0).alias("is_point"))
    asked = points.select(*on, F.col("pc").alias("at"), F.lit(None).cast("struct<symbol_address:bigint,symbol:string>").alias("s"), F.lit(1).alias("is_point"))
    rows = marks.unionByName(asked).withColumn("b", bucket(F.col("at"), width))
    order = Window.partitionBy(*on, "b").orderBy("at", "is_point", "s.symbol").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("seen", F.last("s", ignorenulls=True).over(order))
    ends = rows.groupBy(*on, "b").agg(F.max("s").alias("last_s"))
    across = Window.partitionBy(*on).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("last_s", ignorenulls=True).over(across)).drop("last_s")
    found = seen.where("is_point = 1").join(ends, [*on, "b"], "left")
    return found.select(*on, F.col("at").alias("pc"), F.coalesce("seen", "carried").alias("near"))


def local_names(resolved: DataFrame, names: DataFrame, on: Sequence[str]) -> DataFrame:
    """``resolved`` with ``display_name``: a local name at the symbol's address, else at the pc, else the symbol."""
    own = names.select(*on, F.col("address").alias("__at"), F.col("name").alias("__own"))
    rows = resolved.withColumn("__at", F.coalesce("symbol_address", "pc")).join(own, [*on, "__at"], "left")
    return rows.withColumn("display_name", F.coalesce("__own", "symbol")).drop("__at", "__own")


def dedupe_symbols(symbols: DataFrame, on: Sequence[str]) -> DataFrame:
    """One symbol for each address: the lowest precedence number, then the name."""
    pick = F.min(F.struct("precedence", "name", "size"))
    return symbols.groupBy(*on, "address").agg(pick.alias("s")).select(*on, "address", F.col("s.size").alias("size"), F.col("s.name").alias("name"))
