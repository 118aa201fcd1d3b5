"""Timelines: pages by key with tamper-proof cursors, places of rows, tails, display rows."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracelake.functions.scalars import bounded_display
from tracelake.functions.u64 import u64_hex, u64_key, u64_str
from tracelake.operators.filters import EventFilter, digest
from tracelake.schema import KEY, Trace, key_order

MAX_PAGE = 2000


class CursorError(ValueError):
    """A cursor that is damaged or belongs to another store or filter."""


def encode_cursor(store: str, wanted: EventFilter, key: tuple) -> str:
    body = json.dumps([1, store, digest(wanted), list(key)], separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(body + hashlib.sha256(body).digest()).decode()


def decode_cursor(text: str, store: str, wanted: EventFilter) -> tuple:
    try:
        data = base64.urlsafe_b64decode(text.encode())
        body, check = data[:-32], data[-32:]
        if hashlib.sha256(body).digest() != check:
            raise CursorError("the cursor is damaged")
        version, at, filter_id, key = json.loads(body)
    except CursorError:
        raise
    except ValueError as e:
        raise CursorError("the cursor can't be read") from e
    if version != 1 or at != store or filter_id != digest(wanted):
        raise CursorError("the cursor belongs to another store, filter or version")
    return tuple(key)


def after_key(key: tuple) -> Column:
    """Whether a row's key is greater than ``key`` in the total order; an absent value comes first."""
    test = F.lit(False)
    for name, value in reversed(list(zip(KEY, key, strict=True))):
        c = F.col(name) if name == "artifact" else u64_key(F.col(name))
        if value is None:
            test = c.isNotNull() | (c.isNull() & test)
            continue
        v = F.lit(value) if name == "artifact" else u64_key(F.lit(value).cast("bigint"))
        test = F.coalesce((c > v) | ((c == v) & test), F.lit(False))
    return test


def page(rows: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The first ``limit`` rows after a key, in key order (a top-k, never a full sort)."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    if after is not None:
        rows = rows.where(after_key(after))
    return rows.orderBy(*key_order()).limit(limit)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next: str | None
    total: int | None
    exact_total: bool


def query_page(rows: DataFrame, store: str, wanted: EventFilter, limit: int, cursor: str | None = None, count: bool = True) -> Page:
    """One page of already filtered ``rows`` with the cursor of the next, null at the end."""
    after = decode_cursor(cursor, store, wanted) if cursor else None
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    left = rows.where(after_key(after)) if after else rows
    got = left.orderBy(*key_order()).limit(limit + 1).collect()  # bounded by MAX_PAGE + 1
    more = len(got) > limit
    got = got[:limit]
    next_cursor = encode_cursor(store, wanted, tuple(got[-1][k] for k in KEY)) if more else None
    return Page(got, next_cursor, rows.count() if count else None, count)


def row_places(rows: DataFrame, bits: int = 16) -> DataFrame:
    """Rows with ``place``, their 0-based number in key order within their artifact and timeline.

    Rows are numbered within buckets of 2**bits record ordinals (which lead the order
    within a timeline) and shifted by the counts of the buckets before, so that no
    task holds a timeline.
    """
    parted = rows.withColumn("__part", F.shiftright(u64_key(F.col("record_ordinal")), bits))
    inside = Window.partitionBy("artifact", "timeline", "__part").orderBy(*key_order())
    numbered = parted.withColumn("__in", F.row_number().over(inside) - 1)
    sizes = parted.groupBy("artifact", "timeline", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("artifact", "timeline").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = numbered.join(starts.drop("__n"), ["artifact", "timeline", "__part"])
    return joined.withColumn("place", (F.col("__start") + F.col("__in")).cast("bigint")).drop("__part", "__in", "__start")


def locate(rows: DataFrame, source_row: int, limit: int) -> DataFrame:
    """(place, page_start) of a visible row: how many rows come before it; no row if it isn't visible."""
    at = rows.where(F.col("source_row") == source_row).select(*[F.col(k).alias(f"at_{k}") for k in KEY])
    before = rows.alias("r").join(F.broadcast(at.limit(1)), how="cross")  # one row by the limit
    test = F.lit(False)
    for name in reversed(KEY):
        c, v = F.col(f"r.{name}"), F.col(f"at_{name}")
        c, v = (c, v) if name == "artifact" else (u64_key(c), u64_key(v))
        less = F.coalesce(c < v, c.isNull() & v.isNotNull())
        test = less | (c.eqNullSafe(v) & test)
    place = F.count(F.when(test, 1))
    found = before.agg(place.alias("place"), F.count("*").alias("n")).where("n > 0")
    return found.select("place", (F.floor(F.col("place") / limit) * limit).cast("bigint").alias("page_start"))


def page_at(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """The page that contains the row at ``offset`` of the projection."""
    start = offset // limit * limit
    return rows.orderBy(*key_order()).offset(start).limit(limit)


def tail(rows: DataFrame, n: int, after: int = 0, until: int | None = None) -> DataFrame:
    """The last ``n`` rows with after < sequence <= until, newest last, each with ``has_more``."""
    inside = _between(rows, after, until).orderBy(u64_key(F.col("sequence")).desc()).limit(n + 1)
    ranked = inside.withColumn("__r", F.row_number().over(Window.orderBy(u64_key(F.col("sequence")).desc())))  # n + 1 rows
    more = F.max("__r").over(Window.partitionBy(F.lit(0))) > n
    return ranked.withColumn("has_more", more).where(F.col("__r") <= n).drop("__r")


def first_after(rows: DataFrame, n: int, after: int = 0, until: int | None = None) -> DataFrame:
    """The first ``n`` rows with after < sequence <= until, each with ``has_more``."""
    inside = _between(rows, after, until).orderBy(u64_key(F.col("sequence"))).limit(n + 1)
    ranked = inside.withColumn("__r", F.row_number().over(Window.orderBy(u64_key(F.col("sequence")))))  # n + 1 rows
    more = F.max("__r").over(Window.partitionBy(F.lit(0))) > n
    return ranked.withColumn("has_more", more).where(F.col("__r") <= n).drop("__r")


def _between(rows: DataFrame, after: int, until: int | None) -> DataFrame:
    key = u64_key(F.col("sequence"))
    rows = rows.where(key > u64_key(F.lit(after).cast("bigint")))
    return rows if until is None else rows.where(key <= u64_key(F.lit(until).cast("bigint")))


def timeline_rows(trace: Trace) -> DataFrame:
    """The projection of a timeline: row, key, kind, provenance, and whether it is a discontinuity."""
    return trace.events.select("source_row", *KEY, "kind", "provenance", (F.col("kind") == "discontinuity").alias("is_discontinuity"))


def display_rows(trace: Trace, summary_bytes: int = 96, detail_bytes: int = 160) -> DataFrame:
    """(artifact, source_row, location, summary): texts for people, bounded in bytes.

    Location is ``module+0xpc``, or ``offset 0x..`` where a row has no place.
    """
    at = trace.instructions.join(trace.definitions.select("artifact", "definition", "mnemonic", "operands"), ["artifact", "definition"], "left")
    at = at.join(trace.modules.select("artifact", "module", F.col("name").alias("module_name")), ["artifact", "module"], "left")
    at = at.select("artifact", F.col("owner_row").alias("source_row"), "module_name", "relative_pc", "mnemonic", "operands")
    said = trace.semantics.select("artifact", F.col("owner_row").alias("source_row"), "category", F.col("name").alias("said"), "detail")
    rows = trace.events.join(at, ["artifact", "source_row"], "left").join(said, ["artifact", "source_row"], "left")
    location = F.when(F.col("relative_pc").isNotNull(), F.concat(F.coalesce("module_name", F.lit("?")), F.lit("+"), u64_hex(F.col("relative_pc")))).otherwise(
        F.concat(F.lit("offset "), u64_hex(F.col("source_offset")))
    )
    summary = (
        F.when(F.col("mnemonic").isNotNull(), bounded_display(F.concat_ws(" ", "mnemonic", "operands"), summary_bytes))
        .when(F.col("said").isNotNull(), bounded_display(F.concat_ws(" ", "said", "detail"), detail_bytes))
        .otherwise(F.col("kind"))
    )
    return rows.select("artifact", "source_row", location.alias("location"), summary.alias("summary"))


def event_detail(trace: Trace, source_row: int) -> DataFrame:
    """Key, kind, position, memory range and semantics of one event, with 64-bit values as text."""
    rows = trace.events.where(F.col("source_row") == source_row)
    side = lambda t, *c: t.where(F.col("owner_row") == source_row).select("artifact", *c)
    rows = rows.join(side(trace.instructions, "module", "relative_pc", "definition"), "artifact", "left")
    rows = rows.join(side(trace.memory, F.col("address").alias("memory_address"), F.col("size").alias("memory_size"), "direction"), "artifact", "left")
    rows = rows.join(side(trace.semantics, "category", "name", "detail"), "artifact", "left")
    return rows.withColumns({"sequence": u64_str(F.col("sequence")), "relative_pc": u64_hex(F.col("relative_pc")), "memory_address": u64_hex(F.col("memory_address"))})
