"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become token pieces of at most ``capacity`` tokens; pieces are dealt out
evenly to groups of a bounded size, and each group is packed on its own: best
fit in decreasing order, then a local search that moves, swaps one for one and
swaps two for one between underfull bins.  Every exchange raises the sum of
squared fills, until the emptiest bins run empty or nothing improves.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import common
from tracelake.plans.session import ship

CAPACITY = 4096
END_ID = 1
#: Rows that a group holds on average; its loss against perfect packing is a bin or so.
GROUP_ROWS = 16_384
#: Exchanges for each bin of a group after which the local search stops; the README has how often that happens.
EFFORT = 20
#: Words whose ids a worker remembers before it starts afresh (a memory bound, not a cap on texts).
REMEMBERED = 800_000
#: Text that is encoded at once.
SLICE_BYTES = 6 << 20
#: Signs between a letter and white space: they are always tokens of their own, so a space before them changes nothing.
SIGNS = r"([a-z])([^a-z0-9'\s\x80-\x{10FFFF}]+)(\s|$)"


class WordCoder:
    """Ids of texts, word by word.

    The vocabulary's tokenizer lower-cases and never joins anything across white space,
    so a text's ids are those of its white-space separated parts in order; parts that
    recur are encoded once.  Special tokens are matched before lower-casing, so a text
    with their opening signs is not lower-cased here.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._coder = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}
        vocabulary = self._coder.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone are one token group each, so many are encoded as one text and cut at the groups' ends."""
        known = self._known
        texts = [w.decode() for w in words]
        odd = [(w, t) for w, t in zip(words, texts, strict=True) if not t.isalpha()]
        plain = [(w, t) for w, t in zip(words, texts, strict=True) if t.isalpha()]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self._ids(" ".join([t for _, t in some]))
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) != len(some):  # a letter that lower-cases into more than letters
                odd += some
                continue
            data, start = ids.tobytes(), 0
            for (w, _), end in zip(some, ends.tolist(), strict=True):
                known[w] = data[start:end]
                start = end
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for (w, _), e in zip(some, self._coder.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _recall(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, in order."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        got = list(map(known.get, words))
        if None in got:
            holes = [i for i, g in enumerate(got) if g is None]
            self._learn([words[i] for i in holes])
            for i in holes:
                got[i] = known[words[i]]
        return got

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text of a string array, without an end id; none for null.

        Arrow splits the texts and numbers their distinct words; those are looked up, and
        numpy gathers every word's ids from one buffer.
        """
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), SIGNS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        edges = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        ids = self._recall(words.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        length = size[at] if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(length)))
        shift = ((np.cumsum(size) - size)[at] if len(ids) else length) - ends[:-1]
        narrow = np.int32 if max(int(ends[-1]), len(pool)) < 2**31 else np.int64
        flat = pool[np.repeat(shift.astype(narrow), length) + np.arange(ends[-1], dtype=narrow)]
        bounds = ends[edges - edges[0]]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_CODERS: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    """A worker's coder for a vocabulary, kept from task to task with what it remembers."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, place): one row for each piece of each row of ``documents``.

    ``ids`` are little-endian unsigned 32-bit ids.  A null or empty text has the end
    id only; repeated ids and equal rows each have their pieces, an empty table has none.
    ``place`` numbers the pieces of a partition, for dealing them out evenly.  Columns
    other than doc_id and text are ignored.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    end = np.array([end_id], dtype="<u4")
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, place bigint"
    target = documents.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        coder = word_coder(tokenizer_path)
        place = (TaskContext.get().partitionId() * 7919) if TaskContext.get() else 0
        for batch in batches:
            for rows in common.bounded_slices(batch, 1, SLICE_BYTES):
                who, piece, start, length, data = [], [], [], [], []
                for i, x in enumerate(coder.encode(rows.column(1))):
                    x = np.append(x, end)
                    for k, a in enumerate(range(0, len(x), capacity)):
                        part = x[a : a + capacity]
                        who.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        data.append(part.tobytes())
                places = np.arange(place, place + len(who), dtype=np.int64)
                place += len(who)
                columns = [rows.column(0).take(pa.array(who, pa.int64())), piece, start, length, data, places]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return documents.select("doc_id", "text").mapInArrow(run, target)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: items in decreasing order, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (space left, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if space > size:
            insort(free, (space - size, b))
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least full bins by moves and swaps; never more bins than given.

    An exchange takes from a bin and fills a fuller one, so the sum of squared fills
    only rises.  Underfull bins give in order of their fill; after any exchange the
    emptiest is tried again.  The search ends at the least possible number of bins,
    when no exchange is left, or after ``EFFORT`` exchanges a bin.
    """
    least = -(-int(lengths.sum()) // capacity)
    fill = [int(lengths[b].sum()) for b in bins]
    size = lengths.tolist()
    alive = set(range(len(bins)))
    stuck: set[int] = set()
    left = EFFORT * len(bins)
    while len(alive) > least and left > 0:
        givers = [b for b in alive if b not in stuck and fill[b] < capacity]
        if not givers:
            break
        low = min(givers, key=lambda b: (fill[b], b))
        before = left
        others = sorted((b for b in alive if b != low and fill[b] < capacity and fill[b] >= fill[low]), key=lambda b: -fill[b])
        improved = True
        while improved and bins[low] and left > 0:
            improved = False
            for item in sorted(bins[low], key=lambda i: -size[i]):
                done = False
                for b in others:
                    space = capacity - fill[b]
                    if space <= 0:
                        continue
                    if size[item] <= space:
                        gone: list[int] = []
                    else:
                        # One for one: the smallest item out that makes room; two for one: two smaller ones.
                        need = size[item] - space
                        inside = sorted((i for i in bins[b] if size[i] < size[item]), key=lambda i: size[i])
                        at = bisect_left([size[i] for i in inside], need)
                        gone = [inside[at]] if at < len(inside) else []
                        if not gone or size[gone[0]] > need:
                            best = size[gone[0]] if gone else size[item]
                            j = len(inside) - 1
                            for i in range(len(inside)):
                                while j > i and size[inside[i]] + size[inside[j]] >= need:
                                    both = size[inside[i]] + size[inside[j]]
                                    if both < best:
                                        best, gone = both, [inside[i], inside[j]]
                                    j -= 1
                                if j <= i:
                                    break
                        if not gone:
                            continue
                    gain = size[item] - sum(size[i] for i in gone)
                    if gain <= 0 or fill[low] - gain < 0:
                        continue
                    bins[low].remove(item)
                    bins[low] += gone
                    bins[b] = [i for i in bins[b] if i not in gone] + [item]
                    fill[b] += gain
                    fill[low] -= gain
                    done = improved = True
                    left -= 1
                    break
                if done:
                    break
        if not bins[low]:
            alive.discard(low)
        if left < before:
            stuck.clear()
        else:
            stuck.add(low)
    return [bins[b] for b in sorted(alive)]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices for one group; full-length items have a bin of their own."""
    full = np.flatnonzero(lengths >= capacity)
    rest = np.flatnonzero(lengths < capacity)
    packed = local_search(best_fit(lengths[rest], capacity), lengths[rest], capacity) if len(rest) else []
    return [[int(i)] for i in full] + [[int(rest[i]) for i in b] for b in packed]


def pack(pieces: DataFrame, expected: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (length, place, ...) with sequence_id and offset in place of ``place``.

    ``expected`` is the number of pieces; it only sets the number of groups, of about
    ``group_rows`` pieces each.  Places are dealt out in turn, so neither a key nor a long
    text can make a group large; they follow the input's partitions, and so do the sequences.
    Null ids, repeated ids and equal rows are pieces like any other; ties go by id and piece.
    An empty table gives an empty table.  Columns named place, sequence_id or offset are replaced.
    """
    ship(pieces.sparkSession)
    groups = max(1, round(expected / group_rows))
    kept = [f for f in pieces.schema.fields if f.name not in ("place", "sequence_id", "offset")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        keys = [("length", "descending"), *((k, "ascending") for k in ("doc_id", "piece") if k in names)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        lengths = rows.column("length").to_numpy().astype(np.int64)
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for k, held in enumerate(pack_lengths(lengths, capacity)):
            sequence[held] = (group << 32) + k
            offset[held] = np.concatenate(([0], np.cumsum(lengths[held])[:-1]))
        return rows.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.select(*names, F.pmod("place", F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(run, schema)
