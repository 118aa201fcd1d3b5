"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has one or more 64-bit words.  Close fingerprints agree on whole
blocks of bits: fingerprints are dealt out by the value of blocks, candidates
within a block are verified by Hamming distance, and the links are closed into
components.

Exact mode (one word, at most ``max_bits`` differing bits): the word is cut in
``max_bits + 4`` blocks; of those, any ``4`` can be the ones that agree, and
each choice of 4 is a table.  Two fingerprints within ``max_bits`` bits share at
least one table's key, so no link is lost.  With two bits a key has at least 42
of the 64 bits, so a key's group holds at most 2**22 distinct fingerprints.

Similar mode (many words): the fingerprint is cut in 128 half-blocks, and two of
them, a fixed step apart, are a table's key.  The width of a half-block grows with
the number of texts, so that a key holds a few unrelated texts at any size; the
number of tables follows from the wanted recall.  Candidates within the Hamming
distance that the wanted Jaccard similarity implies are verified by the exact
similarity of their hashed shingles, in the first table that both share and so
once each.  Fingerprints of few shingles say little, so short texts are joined by
the shingles themselves.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.components import components
from tracelake.plans.session import ship

SEED = 42
PIECE = 16_384  # shingles whose bits are counted at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of A-Z lower-cased words, repeats included; a shorter text is one shingle, none without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(x) for x in zip(*(tokens[i:] for i in range(words)), strict=False)]


def hashes(pieces: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(x, SEED) for x in pieces]), dtype=">u8").astype(np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    """How often each bit of rows of words is set, the first word's highest bit first."""
    bits = np.unpackbits(x.astype(">u8").view(np.uint8), axis=1)
    total = np.zeros(bits.shape[1], dtype=np.int64)
    for at in range(0, len(bits), 255):  # sums of so many bits stay in a byte
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return total


def _majority(h: np.ndarray) -> int:
    """A word whose bits are those set in over half of ``h``; zero for none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), PIECE):
        total += _ones(h[at : at + PIECE, None])
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a null text or one without words has fingerprint zero."""
    return _majority(hashes(shingles(text, words)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, f0) as 64-bit patterns, one row for each row of ``documents``."""

    def work(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "f0": [_signed(fingerprint(t, words)) for t in c["text"]]}

    kind = dict(documents.dtypes)["doc_id"]
    return common.map_batches(documents.select("doc_id", "text"), work, f"doc_id {kind}, f0 bigint")


def block_masks(max_bits: int, agree: int = 4) -> list[int]:
    """Masks of the tables: every choice of ``agree`` out of ``max_bits + agree`` blocks of a word."""
    n = max_bits + agree
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def spanning_links(x: np.ndarray, max_bits: int, mask: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``max_bits`` of one another.

    ``x`` are distinct words that agree on ``mask``.  Small groups are compared
    directly.  In large groups each word looks its neighbours up (all patterns
    that differ in up to ``max_bits`` of the free bits), so the work grows with
    the group and not with its square.
    """
    left = np.arange(len(x))
    links: list[tuple[int, int]] = []
    if len(x) <= 512:
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                distance = np.bitwise_count(x[front[0]] ^ x[left])
                near = distance <= max_bits
                links += [(int(front[0]), int(j)) for j in left[near]]
                front, left = np.concatenate((front[1:], left[near])), left[~near]
        return links
    free = [i for i in range(64) if not mask >> i & 1]
    flips = [np.uint64(sum(1 << i for i in c)) for k in range(1, max_bits + 1) for c in combinations(free, k)]
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    seen = np.zeros(len(x), dtype=bool)
    for start in range(len(x)):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):
            reached = []
            for flip in flips:
                want = x[front] ^ flip
                at = np.minimum(np.searchsorted(ordered, want), len(x) - 1)
                hit = (ordered[at] == want) & ~seen[order[at]]
                found = order[at[hit]]
                seen[found] = True
                links += list(zip(front[hit].tolist(), found.tolist(), strict=True))
                reached.append(found)
            front = np.concatenate(reached)
    return links


def _by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Runs of equal first columns of sorted rows, as column lists; runs of one row are left out."""
    held: list[np.ndarray] = [np.empty(0, dtype=np.int64) for _ in names]
    for batch in batches:
        columns = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        key = columns[0]
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.array([0])
        for a, b in zip(cuts[:-2].tolist(), cuts[1:-1].tolist(), strict=True):
            if b - a > 1:
                yield [c[a:b] for c in columns]
        last = int(cuts[-2]) if len(cuts) > 1 else 0
        held = [c[last:].copy() for c in columns]
    if len(held[0]) > 1:
        yield held


def link_exact(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between ``node`` values of ``distinct`` (node, f0), one row for each distinct f0.

    The links connect all that pairs within ``max_bits`` bits connect.
    """
    masks = block_masks(max_bits)
    tables = [
        F.struct(F.xxhash64(F.lit(i), F.col("f0").bitwiseAND(F.lit(_signed(m)))).alias("key"), F.lit(i).cast("bigint").alias("t"))
        for i, m in enumerate(masks)
    ]
    dealt = (
        distinct.select("node", "f0", F.explode(F.array(*tables)).alias("x"))
        .select("x.key", "x.t", "f0", "node")
        .repartition(F.col("key"))
        .sortWithinPartitions("key", "t", "f0")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, f, node in _by_group(batches, ["key", "t", "f0", "node"]):
            x = f.view(np.uint64)
            # A key is a hash: rows of other tables or block values may share it.
            value = x & np.array(masks, dtype=np.uint64)[table]
            for t, v in np.unique(np.stack((table.view(np.uint64), value)), axis=1).T if len(x) > 2 else [(None, None)]:
                if t is None:
                    if table[0] == table[1] and np.bitwise_count(x[0] ^ x[1]) <= max_bits:
                        yield pa.RecordBatch.from_arrays([pa.array(node[:1]), pa.array(node[1:])], names=["a", "b"])
                    continue
                at = np.flatnonzero((table.view(np.uint64) == t) & (value == v))
                pairs = spanning_links(x[at], max_bits, masks[int(t)])
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[at][a]), pa.array(node[at][b])], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def duplicates(documents: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``documents``.

    Null and empty texts have fingerprint zero and link like any other; rows with
    a null doc_id get their fingerprint, and the component of its other holders
    (null if none has an id).  Repeated rows each get a row; an empty table gives
    an empty table; columns other than doc_id and text are ignored.
    """
    rows = common.materialize(fingerprints(documents, words))
    distinct = rows.groupBy("f0").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    distinct = common.materialize(distinct.select("node", "f0"))
    found = components(link_exact(distinct, max_bits))
    named = distinct.join(found, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "f0", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id"
    )


# Similar mode.

#: Half-blocks of a wide fingerprint; a table's key is two of them.
BLOCKS = 128
#: Sets of so many shingles are joined by their shingles, larger ones by fingerprints.
SHORT = 64
#: Rows of a key that one task compares; a key with more is dealt out in parts and pairs of parts.
GROUP_ROWS = 2048
#: Nodes up to which a table of nodes is broadcast (16 to 40 bytes each); beyond, the join is shuffled.
BROADCAST_NODES = 500_000
#: Chance that a pair of the wanted similarity shares no table.
MISSED = 0.01
#: Text whose words are hashed at once.
SLICE_BYTES = 1 << 20
_GROWTH = math.log(1.1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text's A-Z lower-cased words; a text of fewer words is one shingle.

    A shingle's hash is a polynomial of its words' hashes.
    """
    said = [(t or b"").lower().split() for t in texts.cast(pa.binary()).to_pylist()]
    starts = np.cumsum([0, *map(len, said)])
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, chain.from_iterable(said))), dtype=">u8").astype(np.uint64)
    n = max(0, len(w) - words + 1)
    h = w[:n].copy()
    for i in range(1, words):
        h = h * _BASE + w[i : n + i]
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(h[a : b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:  # the number of words comes in, so that it is no other shingle's polynomial
            one = b - a
            for x in w[a:b].tolist():
                one = (one * int(_BASE) + x) & (1 << 64) - 1
            out.append(np.array([one] if b > a else [], dtype=np.uint64))
    return out


def wide_fingerprint(h: np.ndarray, size: int) -> np.ndarray:
    """``size`` words of 64 bits over a shingle set, each from its own multiplicative hash: bits set in over half of the set."""
    total = np.zeros(size * 64, dtype=np.int64)
    factors = np.array([(2 * k + 1) * int(_BASE) & (1 << 64) - 1 | 1 for k in range(size)], dtype=np.uint64)
    for at in range(0, len(h), PIECE):
        x = h[at : at + PIECE, None] * factors
        x ^= x >> np.uint64(32)
        total += _ones(x)
    return np.packbits(2 * total > len(h)).view(">u8").astype(np.uint64)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Tables:
    """How fingerprints are cut and compared for a number of texts and a similarity."""

    half: int  # bits of a half-block
    count: int  # tables: each half-block with the next, then each with the one after that, and so on
    limit: int  # differing bits of a candidate
    loose: int  # differing bits of 56 that the first screening lets pass
    similarity: float

    @staticmethod
    def fit(texts: int, similarity: float) -> Tables:
        share = differing_share(similarity)
        half = max(8, math.ceil((math.log2(max(texts, 2)) - 2) / 2))
        p, pairs = (1 - share) ** half, BLOCKS * (BLOCKS // 2 - 1)
        # Of the half-blocks, some agree; the chosen pairs may hold none of the pairs of those.
        agree = [(math.comb(BLOCKS, a) * p**a * (1 - p) ** (BLOCKS - a), a * (a - 1) // 2) for a in range(BLOCKS + 1)]
        count = bisect_left(range(pairs), -MISSED, key=lambda c: -sum(chance * (1 - c / pairs) ** both for chance, both in agree))
        bits = BLOCKS * half
        spread = lambda n, k: math.ceil(n * share + k * math.sqrt(n * share * (1 - share)))
        return Tables(half, count, spread(bits, 4.5), spread(56, 2.8), similarity)

    @property
    def size(self) -> int:
        return BLOCKS * self.half // 64

    @property
    def rounds(self) -> int:
        return math.ceil(self.count / BLOCKS)

    def blocks(self, prints: np.ndarray) -> np.ndarray:
        """Half-blocks (rows x BLOCKS) of fingerprints as rows of bytes."""
        if self.half == 8:
            return prints.astype(np.int64)
        bits = np.unpackbits(prints, axis=1).reshape(len(prints), BLOCKS, self.half)
        return bits @ (1 << np.arange(self.half - 1, -1, -1, dtype=np.int64))

    def first_shared(self, different: np.ndarray) -> np.ndarray:
        """The first table in which pairs agree, from their differing bits as rows of bytes; -1 if there is none."""
        same = different == 0 if self.half == 8 else self.blocks(different) == 0
        agree = np.concatenate([same & np.roll(same, -r, axis=1) for r in range(1, self.rounds + 1)], axis=1)[:, : self.count]
        return np.where(agree.any(axis=1), agree.argmax(axis=1), -1)


def _slack(n: np.ndarray) -> np.ndarray:
    """A number of one byte that grows by one when the set grows by a tenth."""
    return np.minimum(255, np.log(np.maximum(n, 1)) / _GROWTH).astype(np.int64)


def wide_fingerprints(documents: DataFrame, words: int, tables: Tables) -> DataFrame:
    """(doc_id, row_hash, text_hash, node, n, print, few), one row for each row of ``documents``.

    ``node`` is a hash of the shingle set, ``n`` its size, ``few`` the set itself where it can be
    similar to one of up to ``SHORT`` shingles.  The first hashes stand for the row and its text.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", *_row_hashes(documents), "text")
    target = documents.sparkSession.createDataFrame([], f"doc_id {kind}, row_hash bigint, text_hash bigint, node bigint, n int, print binary, few array<bigint>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            for part in common.bounded_slices(batch, 3, SLICE_BYTES):
                sets = shingle_sets(part.column(3), words)
                columns = [
                    *part.columns[:3],
                    pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([len(h) for h in sets], pa.int32()),
                    pa.array([wide_fingerprint(h, tables.size).astype(">u8").tobytes() for h in sets], pa.binary()),
                    pa.array([h.view(np.int64) if len(h) * tables.similarity <= SHORT else None for h in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return rows.mapInArrow(run, target)


def _row_hashes(documents: DataFrame) -> list[Column]:
    return [F.xxhash64(documents["doc_id"], documents["text"]).alias("row_hash"), F.xxhash64(documents["text"]).alias("text_hash")]


def likely_members(distinct: DataFrame, tables: Tables) -> DataFrame:
    """(key, node): rows of ``distinct`` (node, n, print, few) that share a key with a row that is not clearly another text.

    A row is dealt out under the keys of all tables with 56 further bits of its
    fingerprint and its length.  Those two decide in a first pass, so that only what
    isn't shared by chance goes on.  Short sets have the shingles as keys (negative
    numbers) of which similar sets must share one: in order of the hash all but those
    that the similarity needs, and one more.  A key of over ``GROUP_ROWS`` rows goes
    on whole and is never held.
    """
    half, size = tables.half, tables.size
    word_of = np.arange(BLOCKS) * half // 64
    top = np.int64(1) << np.int64(63)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: np.ndarray, word: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (key, word, node)], names=["key", "word", "node"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                node, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                slack = _slack(n)
                short = np.flatnonzero(rows.column(3).is_valid().to_numpy(zero_copy_only=False) & (n > 0))
                if len(short):
                    few = [rows.column(3)[i].values.to_numpy() for i in short.tolist()]
                    first = [x[: len(x) - math.ceil(len(x) * tables.similarity - 1e-9) + 1] | top for x in few]
                    times = [len(x) for x in first]
                    yield made(np.concatenate(first), np.repeat(slack[short], times), np.repeat(node[short], times))
                long = np.flatnonzero(n > SHORT)
                if not len(long):
                    continue
                prints = np.frombuffer(b"".join(rows.column(2).take(pa.array(long)).to_pylist()), np.uint8).reshape(len(long), size * 8)
                words = prints.view(">u8").astype(np.uint64)
                blocks = tables.blocks(prints)
                further = words[:, (word_of + size // 2) % size] >> np.uint64(8)
                word = (further.astype(np.int64) << 8) | slack[long, None]
                for r in range(1, tables.rounds + 1):
                    table = np.arange((r - 1) * BLOCKS, min(r * BLOCKS, tables.count), dtype=np.int64)
                    key = (((table << half) | blocks[:, : len(table)]) << half) | np.roll(blocks, -r, axis=1)[:, : len(table)]
                    yield made(key, word[:, : len(table)], np.repeat(node[long], len(table)))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3
        passing = None  # a key that is too large to hold: its rows go on as they come
        for batch in batches:
            key, word, node = (np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
            if not len(key):
                continue
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            lengths = np.diff(np.append(starts, len(key)))
            wide = lengths > GROUP_ROWS
            if passing is not None:
                wide[0] |= key[0] == passing
            passing = key[-1] if wide[-1] else None
            done = len(key) if wide[-1] else int(starts[-1])
            close = _close(key[:done], word[:done], np.repeat(wide, lengths)[:done], tables.loose)
            if close.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:done][close]), pa.array(node[:done][close])], names=["key", "node"])
            held = [key[done:], word[done:], node[done:]]
        key, word, node = held
        close = _close(key, word, np.zeros(len(key), dtype=bool), tables.loose)
        if close.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[close]), pa.array(node[close])], names=["key", "node"])

    dealt = distinct.select("node", "n", "print", "few").mapInArrow(deal, "key bigint, word bigint, node bigint")
    return dealt.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(screen, "key bigint, node bigint")


def _close(key: np.ndarray, word: np.ndarray, close: np.ndarray, loose: int) -> np.ndarray:
    """Rows that are ``close`` already or have another row of their key within ``loose`` bits and a fitting length."""
    at, step = np.flatnonzero(~close), 1
    bits, slack = word.view(np.uint64) >> np.uint64(8), word & 255
    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        # A slack is cut down, so sets of which one has 0.8 of the other's size differ by 3 at most.
        near = (np.bitwise_count(bits[at] ^ bits[at + step]) <= loose) & (np.abs(slack[at] - slack[at + step]) <= 3)
        hit = at[near]
        close[hit] = close[hit + step] = True
        step += 1
    return close


def linked_pairs(
    key: int, nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], tables: Tables, label: np.ndarray, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Pairs of a key's rows that are exactly similar and connect what isn't connected yet.

    ``label`` tells which rows are connected; with ``side`` only pairs of different sides count.
    A pair is looked at in the first table that it shares, so in one group of all.
    """
    links = []
    n = np.array([len(s) for s in sets])
    words = prints.view(np.uint64)
    table = key >> (2 * tables.half)
    for i in range(len(nodes) - 1):
        rest = label[i + 1 :] != label[i]
        if side is not None:
            rest &= side[i + 1 :] != side[i]
        at = np.flatnonzero(rest) + i + 1
        at = at[np.minimum(n[at], n[i]) >= tables.similarity * np.maximum(n[at], n[i]) - 1e-6]
        if key >= 0 and len(at):
            at = at[np.bitwise_count(words[at] ^ words[i]).sum(axis=1, dtype=np.int64) <= tables.limit]
            at = at[tables.first_shared(prints[at] ^ prints[i]) == table] if len(at) else at
        if not len(at):
            continue
        cuts = np.concatenate(([0], np.cumsum(n[at])))
        others = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(sets[i], others), n[i] - 1)
        both = np.add.reduceat(sets[i][place] == others, cuts[:-1], dtype=np.int64)
        hit = at[both / (n[i] + n[at] - both) >= tables.similarity]
        links += [(int(nodes[i]), int(nodes[j])) for j in hit]
        label[np.isin(label, label[hit])] = label[i]
    return links


def _verify(members: DataFrame, tables: Tables, group: list[str]) -> DataFrame:
    """Links (a, b) among ``members`` (key, group.., side, label, node, print, held), group by group."""
    names = ["key", *group, "side", "label", "node", "print", "held"]
    rows = members.select(*names).repartition(*[F.col(c) for c in ("key", *group)]).sortWithinPartitions("key", *group, "node", "side")
    width = 1 + len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            side, label, node, prints, held = zip(*(x[width:] for x in rows), strict=True)
            found = linked_pairs(
                rows[0][0], np.array(node), np.frombuffer(b"".join(prints), np.uint8).reshape(len(rows), -1),
                [np.frombuffer(x, np.uint64) for x in held], tables, np.array(label), np.array(side) if group[-1:] == ["other"] else None,
            )
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        now: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and row[:width] != now[0][:width]:
                    yield from linked(now)
                    now = []
                now.append(row)
        yield from linked(now)

    return rows.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def similar_links(likely: DataFrame, sets: DataFrame, tables: Tables, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect what exactly similar pairs of one key of ``likely`` connect.

    A key with over ``group_rows`` rows is dealt out in parts by the node's hash; pairs of different
    parts that are still apart after that are compared for each two parts.  So no task holds
    more than two parts, and a large group of very similar texts costs little more than its rows.
    """
    counts = likely.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows)
    hot = common.materialize(counts.select("key", F.ceil(F.col("rows") / group_rows).cast("int").alias("parts")))
    first = likely.join(hot, "key", "left").select("key", "node", F.coalesce("parts", F.lit(1)).alias("parts"))
    first = first.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    own = first.withColumn("side", F.lit(0)).withColumn("label", F.col("node")).join(sets, "node")
    links = common.materialize(_verify(own, tables, ["part"]))
    if not hot.limit(1).count():
        return links
    label = components(links)
    rows = first.where("parts > 1").join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    rows = rows.withColumn("__other", other).withColumn("side", F.col("part"))
    cells = rows.withColumn("one", F.least("part", "__other")).withColumn("other", F.greatest("part", "__other"))
    return links.union(_verify(cells.join(sets, "node"), tables, ["one", "other"])).distinct()


def _sets_of(documents: DataFrame, rows: DataFrame, asked: DataFrame, words: int, tables: Tables) -> DataFrame:
    """(node, print, held: the set's hashes as bytes) of the ``asked`` nodes, from one text of each."""
    asked = common.materialize(asked)
    small = asked.count() <= BROADCAST_NODES
    reach = lambda d: F.broadcast(d) if small else d
    texts = rows.select("node", "row_hash", "text_hash").join(reach(asked), "node", "left_semi")
    texts = common.materialize(texts.groupBy("node").agg(F.min(F.struct("row_hash", "text_hash")).alias("x")).select("x.*"))
    hashed = documents.select(*_row_hashes(documents), "text")
    chosen = hashed.join(reach(texts), ["row_hash", "text_hash"], "left_semi").dropDuplicates(["row_hash", "text_hash"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.bounded_slices(batch, 0, SLICE_BYTES):
                sets = shingle_sets(part.column(0), words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([wide_fingerprint(h, tables.size).astype(">u8").tobytes() for h in sets], pa.binary()),
                    pa.array([h.tobytes() for h in sets], pa.binary()),
                ], names=["node", "print", "held"])

    return common.materialize(chosen.mapInArrow(run, "node bigint, print binary, held binary"))


def similar_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, row_hash, text_hash, similar): a number for each group of near-duplicates, for each row of ``documents``.

    Groups are the components of links between texts of at least this Jaccard similarity of
    shingles.  Texts without words are copies of one another.  Ids play no part.
    """
    tables = Tables.fit(documents.count(), similarity)
    rows = common.materialize(wide_fingerprints(documents, words, tables))
    distinct = rows.select("node", "n", "print", "few").dropDuplicates(["node"])
    likely = common.materialize(likely_members(distinct, tables))
    sets = _sets_of(documents, rows, likely.select("node").distinct(), words, tables)
    found = components(similar_links(likely, sets, tables, group_rows))
    return rows.join(found, "node", "left").select("doc_id", "row_hash", "text_hash", F.coalesce("component", "node").alias("similar"))


def keep_one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: the smallest doc_id, a null one last.

    Every row is judged by its own text, also one without an id or with an id that other
    texts have.  Of an id's texts in one group the one with the smallest hash stays, of equal rows one.
    Texts without words are copies of one another.  An empty table stays empty; other columns,
    whatever their names, are kept as they are.
    """
    groups = similar_groups(documents, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "row_hash")
    stays = groups.groupBy("similar").agg(F.min(order).alias("x")).select(F.col("x.row_hash").alias("stays_row"), F.col("x.text_hash").alias("stays_text"))
    names = ["__row_hash", "__text_hash"]
    hashed = documents.select("*", *[h.alias(n) for h, n in zip(_row_hashes(documents), names, strict=True)])
    kept = hashed.join(stays, (hashed[names[0]] == stays["stays_row"]) & (hashed[names[1]] == stays["stays_text"]), "left_semi")
    # The join leaves rows dealt out by the hashes, so this needs no further exchange.
    return kept.dropDuplicates(names).select(*documents.columns)
