"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

An item window is ``size`` consecutive words of a benchmark item (an item of
fewer words is one window).  Containment must be complete, so a window's prefix
is one token: its rarest shingle by corpus count.  Documents' shingles join on
those prefix tokens only; the window's place around the token must lie within
the document (positional and length bounds); then the words are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.url_reputation import LOWER, UPPER

WINDOW = 10
SHINGLE = 3
#: Windows of a benchmark up to which they are broadcast (at 10 words and an item's name each, some 30 MB); beyond, they are shuffled.
BROADCAST_WINDOWS = 100_000
#: Fixed value: what separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window: words, n, items: ids as sorted strings) of the distinct windows."""
    words = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    return (
        words.where(n > 0)
        .select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1))).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(size)).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("n", F.size("window"))
    )


def _token(words: str, at: Column, k: int) -> Column:
    """Hash of ``k`` words from the 0-based place ``at``; null past the end."""
    parts = [F.get(F.col(words), at + i) for i in range(k)]
    inside = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts[-1:]])
    return F.when(inside, F.xxhash64(F.lit(k), *parts))


def _window_tokens(windows: DataFrame, k: int) -> DataFrame:
    """(window, n, items, at, token) for every shingle of the windows that are dealt out by ``k`` words."""
    mine = windows.where(F.least(F.col("n"), F.lit(SHINGLE)) == k)
    spread = mine.select("window", "n", "items", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("at"))
    return spread.withColumn("token", _token("window", F.col("at"), k))


def _occurrences(documents: DataFrame, families: list[int]) -> DataFrame:
    """Every word place of every document with one token for each family."""
    tokens = [_token("w", F.col("pos"), k).alias(f"token{k}") for k in families]
    return documents.select("*", F.posexplode("w").alias("pos", "word")).select(*documents.columns, "pos", *tokens)


def hits(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans (start, length), items), one row for each row of ``documents``.

    Null and empty texts have no words and no spans.  Every row is judged by its own
    text, also one with a null id or an id that other texts have; equal rows each get
    their row.  An empty benchmark gives no spans, an empty table no rows; columns
    other than doc_id and text, whatever their names, are ignored.
    """
    found = dirty_texts(documents, benchmark, size).withColumnsRenamed({"doc_id": "found_id", "same": "found_text"})
    rows = documents.select("doc_id", F.xxhash64("text").alias("same"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]) & (rows["same"] == found["found_text"]), "left")
    none = F.array().cast("array<struct<start:int,length:int>>")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def dirty_texts(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, same, spans, items) of each distinct (doc_id, hash of the text) that holds a window."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("same"), words_of(F.col("text")).alias("w"))
    docs = docs.withColumn("n_words", F.size("w"))
    windows = common.materialize(item_windows(benchmark, size))
    n_windows = windows.count()
    families = sorted(r[0] for r in windows.select(F.least(F.col("n"), F.lit(SHINGLE))).distinct().collect())
    small = n_windows <= BROADCAST_WINDOWS
    spread = [(_window_tokens(windows, k), k) for k in families]
    if not families:
        kind = dict(documents.dtypes)["doc_id"]
        return documents.sparkSession.createDataFrame([], f"doc_id {kind}, same bigint, spans array<struct<start:int,length:int>>, items array<string>")
    # Rarity: how often each token occurs in all documents, counted for item tokens only.
    asked = reduce(DataFrame.union, [x.select(F.col("token").alias("asked")) for x, _ in spread]).distinct()
    places = _occurrences(docs.select("w"), families)
    said = places.select(F.explode(F.array(*[f"token{k}" for k in families])).alias("token")) if len(families) > 1 else places.select(F.col(f"token{families[0]}").alias("token"))
    counts = said.join(F.broadcast(asked) if small else asked, said["token"] == F.col("asked"), "left_semi").groupBy("token").agg(F.count("*").alias("times"))
    counts = common.materialize(counts)

    start = F.col("pos") - F.col("at")
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    exact = bounds & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window"))
    found = None
    for x, k in spread:
        rare = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "token")).alias("rare")
        chosen = x.join(counts, "token", "left").groupBy("window", "n").agg(rare, F.first("items").alias("items"))
        prefix = chosen.where("rare.times > 0").select("window", "n", "items", F.col("rare.at").alias("at"), F.col("rare.token").alias("prefix"))
        here = _occurrences(docs, [k])
        if small:
            joined = here.join(F.broadcast(prefix), F.col(f"token{k}") == F.col("prefix"))
        else:
            # Too many windows to broadcast: tokens travel without the texts, which come back for candidates only.
            ids = here.select("doc_id", "same", "pos", "n_words", f"token{k}").join(prefix, F.col(f"token{k}") == F.col("prefix")).where(bounds)
            back = docs.select(F.col("doc_id").alias("d"), F.col("same").alias("s"), "w").dropDuplicates(["d", "s"])
            joined = ids.join(back, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("same").eqNullSafe(F.col("s")))
        rows = joined.where(exact).select("doc_id", "same", F.struct(start.alias("start"), F.col("n").alias("length")).alias("span"), "items")
        found = rows if found is None else found.union(rows)
    return found.groupBy("doc_id", "same").agg(
        F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def covered(spans: Column) -> Column:
    """Places that the sorted ``spans`` cover, each counted once."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))

    def step(held: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(held["end"], x["start"]))
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["total"] + fresh).alias("total"))

    return F.aggregate(spans, begin, step, lambda held: held["total"])


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark window.

    Every row is judged by its own text, also one with a null id or with an id that other texts have;
    null and empty texts stay, equal rows each stay or go, and all columns are kept.
    """
    dirty = dirty_texts(documents, benchmark).select(F.col("doc_id").alias("dirty_id"), F.col("same").alias("dirty_text"))
    same = documents["doc_id"].eqNullSafe(dirty["dirty_id"]) & (F.xxhash64(documents["text"]) == dirty["dirty_text"])
    return documents.join(dirty, same, "left_anti").select(*documents.columns)
