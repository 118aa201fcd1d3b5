"""Line dedup by pairwise alignment.

Documents that share text are found through hashes of runs: from every line, and
up to every line, the fewest consecutive lines that have enough words.  A run's
hash points to the first document that holds it, so a run in any number of
documents gives one pair for each later holder and never all pairs.  Each pair
is aligned with patience diff, and common blocks of enough words are deleted
from the later document.  Every line of such a block lies in a run of the block,
and the runs that led to a pair are deleted however it is aligned, so the first
holders stand for all earlier ones and no block is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common

#: A common block of fewer words stays.
MIN_BLOCK_WORDS = 30
#: Documents are aligned in parts of so many lines, each with a margin on both sides.
PART_LINES, MARGIN_LINES = 128, 32
#: A part's number has the document's text hash (so many bits) above its place, so that texts of one id stay apart.
TEXT_BITS, PLACE_BITS = 40, 23


def _anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Increasing pairs of places of lines that occur once in ``a`` and once in ``b``; else of first occurrences."""
    once_a, first_a, count_a = np.unique(a, return_index=True, return_counts=True)
    once_b, first_b, count_b = np.unique(b, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(once_a, once_b, assume_unique=True, return_indices=True)
    ia, ib = ia[once_a[ia] != 0], ib[once_b[ib] != 0]
    if not len(ia):
        return []
    single = (count_a[ia] == 1) & (count_b[ib] == 1)
    if single.any():
        ia, ib = ia[single], ib[single]
    at = sorted(zip(first_b[ib].tolist(), first_a[ia].tolist(), strict=True))
    # The longest increasing subsequence, patience-style.
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, x) in enumerate(at):
        p = bisect_left(tops, x)
        if p == len(tops):
            tops.append(x)
            ends.append(k)
        else:
            tops[p], ends[p] = x, k
        back.append(ends[p - 1] if p else -1)
    path, k = [], ends[-1]
    while k >= 0:
        path.append(at[k])
        k = back[k]
    return [(x, y) for y, x in reversed(path)]


def common_blocks(a: np.ndarray, b: np.ndarray, words_b: np.ndarray, least: int = MIN_BLOCK_WORDS) -> list[tuple[int, int]]:
    """Spans [start, stop) of lines of ``b`` that lie in blocks common with ``a`` of at least ``least`` words.

    Line hash 0 is a blank line.  Anchors grow in both directions over equal lines;
    what is left of ``b`` is aligned again until no further block is found, so moved
    and repeated blocks count too.
    """
    taken = np.zeros(len(b), dtype=bool)
    total = np.concatenate(([0], np.cumsum(words_b)))
    spans: list[tuple[int, int]] = []
    known = set(a.tolist())
    shared = np.fromiter((x in known for x in b.tolist()), dtype=bool, count=len(b))
    while True:
        left = np.where(taken | ~shared, np.int64(0), b)
        found = False
        for i, j in _anchors(a, left):
            if taken[j]:
                continue
            lo_a, lo_b, hi_a, hi_b = i, j, i + 1, j + 1
            while lo_a and lo_b and not taken[lo_b - 1] and a[lo_a - 1] == b[lo_b - 1]:
                lo_a, lo_b = lo_a - 1, lo_b - 1
            while hi_a < len(a) and hi_b < len(b) and not taken[hi_b] and a[hi_a] == b[hi_b]:
                hi_a, hi_b = hi_a + 1, hi_b + 1
            # A block too short is looked at once; it stays in the text.
            taken[lo_b:hi_b] = True
            found = True
            if total[hi_b] - total[lo_b] >= least:
                spans.append((lo_b, hi_b))
        if not found:
            return sorted(spans)


def least_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """Sorted spans [start, stop): from every line and up to every line with words, the fewest lines of ``least`` words."""
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    held = np.flatnonzero(words)
    stop = np.searchsorted(total, total[held] + least)
    start = np.searchsorted(total, total[held + 1] - least, side="right") - 1
    down = zip(held[stop < len(total)].tolist(), stop[stop < len(total)].tolist(), strict=True)
    up = zip(start[start >= 0].tolist(), (held[start >= 0] + 1).tolist(), strict=True)
    return sorted({*down, *up})


def text_mark(documents: DataFrame) -> Column:
    return F.xxhash64(documents["text"]).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))


def line_parts(documents: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, part, first, lines, words, runs): hashed lines of each distinct text of each document, in parts.

    ``runs`` (hash, start, stop) are those of the whole document that start in the part's own lines.
    """
    kind = dict(documents.dtypes)["doc_id"]
    names = ("doc_id", "part", "first", "lines", "words", "runs")

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in names}
        digest = xxhash.xxh64_intdigest
        for doc, mark, text in zip(c["doc_id"], c["mark"], c["text"], strict=True):
            lines, words = [], []
            for x in text.encode("utf-8", "replace").split(b"\n"):
                n = len(x.split())
                words.append(n)
                h = digest(x.strip()) if n else 0
                lines.append(h - (1 << 64) if h >= 1 << 63 else h)
            whole = np.array(lines, dtype=np.int64)
            runs: dict[int, list[dict]] = {}
            for start, end in least_runs(words, least):
                h = digest(whole[start:end].tobytes())
                runs.setdefault(start // PART_LINES, []).append({"hash": h - (1 << 64) if h >= 1 << 63 else h, "start": start, "stop": end})
            for part, at in enumerate(range(0, len(lines), PART_LINES)):
                first, stop = max(0, at - MARGIN_LINES), min(len(lines), at + PART_LINES + MARGIN_LINES)
                out["doc_id"].append(doc)
                out["part"].append(mark << PLACE_BITS | part)
                out["first"].append(first)
                out["lines"].append(lines[first:stop])
                out["words"].append(words[first:stop])
                out["runs"].append(runs.get(part, []))
        return out

    rows = documents.select("doc_id", text_mark(documents).alias("mark"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = f"doc_id {kind}, part bigint, first int, lines array<bigint>, words array<int>, runs array<struct<hash:bigint,start:int,stop:int>>"
    return common.map_batches(rows, work, schema)


def overlaps(parts: DataFrame) -> DataFrame:
    """(doc_id, part, earlier, earlier_part, led: spans of the shared runs): pairs of parts to align."""
    runs = parts.select("doc_id", "part", F.explode("runs").alias("x")).select(
        F.col("x.hash").alias("run"), (F.col("x.stop") - F.col("x.start")).alias("n"), F.col("x.start").alias("start"), "doc_id", "part"
    )
    # Grouped by lines as well (a run has one count), so that the join deals both sides out anew
    # by run alone, as plain exchanges, and a run that very many documents hold can be split.
    first = runs.groupBy("run", "n").agg(
        F.min(F.struct("doc_id", "part")).alias("earlier"), F.max("doc_id").alias("last")
    ).where("last > earlier.doc_id").select(F.col("run").alias("shared"), F.col("n").alias("shared_n"), F.col("earlier.doc_id").alias("earlier"), F.col("earlier.part").alias("earlier_part"))
    return (
        runs.join(first, F.col("run") == F.col("shared"))
        .where("doc_id > earlier AND n = shared_n")
        .groupBy("doc_id", "part", "earlier", "earlier_part")
        .agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("led"))
    )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that share lines are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def deletions(documents: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, mark: of the text, spans: sorted [start, stop) of lines to delete, sources: earlier documents)."""
    parts = common.materialize(line_parts(documents, least))
    pairs = overlaps(parts)
    early = parts.select(F.col("doc_id").alias("earlier"), F.col("part").alias("earlier_part"), F.col("lines").alias("early_lines"))
    both = (
        pairs.join(early, ["earlier", "earlier_part"])
        .join(parts.select("doc_id", "part", "first", "lines", "words"), ["doc_id", "part"])
        .select("doc_id", "earlier", "first", "early_lines", "lines", "words", "led", F.shiftright("part", PLACE_BITS).alias("mark"))
    )
    kind = dict(documents.dtypes)["doc_id"]
    target = documents.sparkSession.createDataFrame([], f"doc_id {kind}, mark bigint, earlier {kind}, start int, stop int").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            who, start, stop = [], [], []
            first = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                a, b, w = (np.asarray(batch.column(k)[i].values.to_numpy(zero_copy_only=False)) for k in (3, 4, 5))
                led = [(x["start"], x["stop"]) for x in batch.column(6)[i].as_py()]
                for x, y in _merged(led + [(first[i] + x, first[i] + y) for x, y in common_blocks(a, b, w, least)]):
                    who.append(i)
                    start.append(x)
                    stop.append(y)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 7, 1)), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], schema=out)

    return both.mapInArrow(run, target).groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set("earlier")).alias("sources")
    )


def _without_deleted(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, Column]:
    """(rows joined to their deletions, the deletions, the text that stays)."""
    cut = deletions(documents, least).select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), F.col("spans").alias("deleted_spans"), F.col("sources").alias("copied_from"))
    joined = documents.join(cut, (documents["doc_id"] == cut["cut_id"]) & (text_mark(documents) == cut["cut_mark"]), "left")
    spans = cut["deleted_spans"]
    lines = F.split(documents["text"], "\n", -1)
    stays = F.filter(lines, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"])))
    return joined, cut, F.when(spans.isNull(), documents["text"]).otherwise(F.array_join(stays, "\n"))


def dedup(documents: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``documents`` with ``text`` less its deleted lines, and columns ``deleted_spans`` and ``copied_from``.

    The earlier document is the one with the smaller doc_id.  A null text stays
    null, an empty one empty; rows with a null doc_id are left as they are.  Texts that
    share a doc_id are each held against earlier ids, not against one another, and
    each loses its own lines only; equal rows each stay.  An empty table gives an empty table.  Columns named deleted_spans or copied_from are replaced.
    """
    joined, cut, text = _without_deleted(documents, least)
    keep = [c for c in documents.columns if c not in ("deleted_spans", "copied_from")]
    return joined.select(*[text.alias(c) if c == "text" else documents[c] for c in keep], cut["deleted_spans"], cut["copied_from"])


def clean(documents: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``documents`` after ``dedup``, with n_chars brought up to date and without texts that lost every word.

    Nulls, repeated ids and rows, and an empty table fare as in ``dedup``; the columns are those of ``documents``.
    """
    joined, cut, text = _without_deleted(documents, least)
    joined = joined.where(cut["deleted_spans"].isNull() | text.rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": text, "n_chars": F.length(text)}
    return joined.select(*[fresh[c].cast(t).alias(c) if c in fresh else documents[c] for c, t in documents.dtypes])
