"""Toxicity by nearest labelled examples.

A text is a TF-IDF vector over every term that an example holds: words, and the
beginnings of words.  Inverse document frequencies are counted over all
documents; a term's weight also grows with its chi-squared against the examples'
labels (relevance weighting), so that neighbours are alike in what tells toxic
texts apart and not only in their subject.  Words that no example holds can match
nothing and are left out.

The examples stand in an inverted index.  Posting lists of rare terms are read
whole; those of common terms are cut in blocks of examples, and a block is read
only while the rare terms' sum and the block's greatest weights can still reach a
text's nearest examples, so the neighbours are exact.  A text is never its own
neighbour.  Distance-weighted votes become a probability by logistic calibration
on examples that don't vote for themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.plans.session import ship

#: Labelled texts that become examples at most (about), by label 0 and 1; the choice is by hash.
MAX_EXAMPLES = (1_000, 1_000)
#: Examples that the calibration asks at most.
MAX_CALIBRATION = 2_000
NEIGHBOURS = 25
BLOCK = 64
#: A term that this share of the examples holds is common.
COMMON = 1 / 16
BEGINNINGS = (4, 5, 6, 7)
#: Chi-squared at which a term's relevance doubles its square weight.
RELEVANT = 3.0
POWER = 3.0  # votes weigh as this power of the cosine
THRESHOLD = 0.7
#: Queries that are scored at once, and text that is split at once.
QUERIES, SLICE_BYTES = 64, 1 << 20
#: Words whose terms a worker remembers before it starts afresh.
REMEMBERED = 200_000


def terms_of(word: str) -> list[int]:
    """Hashes of the word itself and of its beginnings, marked by a caret."""
    return [xxhash.xxh64_intdigest(x) for x in (word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k))]


class TermCounter:
    """Counts of vocabulary terms (sorted hashes); without a vocabulary every term counts."""

    def __init__(self, vocabulary: np.ndarray | None) -> None:
        self._vocabulary = vocabulary
        self._known: dict[str, np.ndarray] = {}

    def _terms(self, words: list[str]) -> list[np.ndarray]:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [w for w in words if w not in known]
        if fresh:
            hashes = [terms_of(w) for w in fresh]
            flat = np.array([h for x in hashes for h in x], dtype=np.uint64)
            cuts = np.cumsum([len(x) for x in hashes])[:-1]
            if self._vocabulary is None:
                found = np.split(flat, cuts)
            else:
                v = self._vocabulary
                at = np.minimum(np.searchsorted(v, flat), max(0, len(v) - 1))
                ok = v[at] == flat if len(v) else np.zeros(len(flat), bool)
                found = [a[o] for a, o in zip(np.split(at, cuts), np.split(ok, cuts), strict=True)]
            known.update(zip(fresh, found, strict=True))
        return [known[w] for w in words]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, terms, tf): each text's terms in order; numbers of the vocabulary, or hashes without one."""
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}]+")
        edges = lists.offsets.to_numpy().astype(np.int64)
        said = lists.flatten().dictionary_encode()
        names = said.dictionary.to_pylist()
        of_word = self._terms([w for w in names if w])
        if "" in names:
            of_word.insert(names.index(""), np.zeros(0, np.uint64 if self._vocabulary is None else np.int64))
        if not of_word:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(texts)), np.diff(edges))
        pairs, times = np.unique(text * len(names) + said.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, word = pairs // len(names), pairs % len(names)
        size = np.array([len(x) for x in of_word])
        flat = np.concatenate(of_word)
        values = None
        if self._vocabulary is None:
            values, flat = np.unique(flat, return_inverse=True)
        terms = flat[spans((np.cumsum(size) - size)[word], size[word])]
        span = max(1, len(values) if values is not None else len(self._vocabulary))
        keys = np.repeat(text, size[word]) * span + terms
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        tf = np.add.reduceat(np.repeat(times, size[word])[order], first) if len(keys) else first
        keys = keys[first]
        found = keys % span
        return np.searchsorted(keys // span, np.arange(len(texts) + 1)), found if values is None else values[found].view(np.int64), tf.astype(np.int32)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size of each pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass(frozen=True)
class Rows:
    """Sparse unit rows: those of row i are terms[offsets[i]:offsets[i+1]] in order."""

    offsets: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(offsets: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> Rows:
        """TF-IDF rows; a text without terms is an empty row."""
        values = (1.0 + np.log(tf)) * weight[terms]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        length = np.sqrt(np.bincount(row, values * values, minlength=len(offsets) - 1))
        return Rows(offsets, terms, values / np.maximum(length, 1e-12)[row])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def some(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.offsets)[rows]
        at = spans(self.offsets[rows], size)
        return Rows(np.concatenate(([0], np.cumsum(size))), self.terms[at], self.values[at])


@dataclass(frozen=True)
class BlockIndex:
    """Posting lists of the examples, which stand in blocks of ``BLOCK`` alike ones.

    ``lists``, ``places`` and ``weights`` are the rare terms' postings; ``column`` has the common
    terms' numbers, ``dense`` their weights by example and ``largest`` by block.
    """

    count: int
    members: np.ndarray  # example numbers by place; -1 fills the last block
    place: np.ndarray  # places by example number
    lists: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    largest: np.ndarray

    @staticmethod
    def build(x: Rows, terms: int, rounds: int = 4) -> BlockIndex:
        """Examples that are alike in common terms share blocks (some rounds of spherical k-means), which keeps bounds tight."""
        n = len(x)
        row = np.repeat(np.arange(n), np.diff(x.offsets))
        held = np.bincount(x.terms, minlength=terms)
        column = np.full(terms, -1, dtype=np.int64)
        usual = np.flatnonzero(held >= max(2, COMMON * n))
        column[usual] = np.arange(len(usual))
        here = column[x.terms]
        full = np.zeros((n, len(usual)), dtype=np.float32)
        full[row[here >= 0], here[here >= 0]] = x.values[here >= 0]
        centres = full[np.linspace(0, n - 1, max(1, n // (4 * BLOCK))).astype(int)] if n else full
        nearest = np.zeros(n, dtype=int)
        for _ in range(rounds if n else 0):
            nearest = np.argmax(full @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, full)
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        order = np.argsort(nearest, kind="stable")
        blocks = -(-n // BLOCK)
        members = np.full(blocks * BLOCK, -1, dtype=np.int64)
        members[:n] = order
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        dense = np.zeros((len(usual), blocks * BLOCK), dtype=np.float32)
        dense[:, :n] = full[order].T
        rare = np.flatnonzero(here < 0)
        rare = rare[np.argsort(x.terms[rare], kind="stable")]
        lists = np.concatenate(([0], np.cumsum(np.where(column < 0, held, 0))))
        largest = dense.reshape(len(usual), blocks, BLOCK).max(axis=2) if blocks else np.zeros((len(usual), 0), np.float32)
        return BlockIndex(n, members, place, lists, place[row[rare]], x.values[rare].astype(np.float32), column, dense, largest)

    def nearest(self, queries: Rows, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the ``k`` nearest for each query, best first; -1 where there are fewer.

        ``skip`` is an example (or -1) for each query that is left out.  Ties go to the smaller example number.
        """
        who = np.full((len(queries), k), -1, dtype=np.int64)
        near = np.full((len(queries), k), -1.0)
        for at in range(0, len(queries) if self.count else 0, QUERIES):
            rows = np.arange(at, min(at + QUERIES, len(queries)))
            who[rows], near[rows] = self._nearest(queries.some(rows), k, None if skip is None else skip[rows])
        return who, near

    def _nearest(self, q: Rows, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(q), len(self.members)
        row = np.repeat(np.arange(n), np.diff(q.offsets))
        start = self.lists[q.terms]
        size = self.lists[q.terms + 1] - start
        at = spans(start, size)
        rare = np.bincount(np.repeat(row * width, size) + self.places[at], np.repeat(q.values, size) * self.weights[at], minlength=n * width).reshape(n, width)
        usual = np.zeros((n, len(self.dense)), dtype=np.float32)
        here = self.column[q.terms]
        usual[row[here >= 0], here[here >= 0]] = q.values[here >= 0]
        bound = rare.reshape(n, -1, BLOCK).max(axis=2) + usual @ self.largest + 1e-5
        score = np.full((n, width), -1.0)
        empty = self.members < 0

        def look(todo: np.ndarray) -> None:
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                rows, part = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                score[rows, part] = rare[rows, part] + usual[rows] @ self.dense[:, part]
            score[:, empty] = -1.0
            if skip is not None:
                asked = np.flatnonzero(skip >= 0)
                score[asked, self.place[skip[asked]]] = -1.0

        best = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(best, np.argsort(-bound, axis=1)[:, : 1 + -(-k // BLOCK)], True, axis=1)
        look(best)
        if width > k:
            least = np.partition(score, width - k, axis=1)[:, width - k]
            look((bound >= least[:, None]) & ~best)
        else:
            look(~best)
        # A smaller example number wins a tie in the sixth digit.
        score = np.where(score < 0, -1.0, np.round(score, 6) - self.members * 1e-12)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k] if width <= 4 * k else np.argpartition(-score, k, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
        near = np.take_along_axis(score, top, 1)
        who = np.where(near < -0.5, -1, self.members[top])
        out_who, out_near = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -1.0)
        out_who[:, : top.shape[1]], out_near[:, : top.shape[1]] = who, np.where(who < 0, -1.0, np.round(near, 6))
        return out_who, out_near


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes of the terms
    weight: np.ndarray
    index: BlockIndex
    ids: list
    labels: np.ndarray
    line: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    prior: float = 0.5

    def votes(self, who: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Log odds of the distance-weighted votes, with the prior as one vote."""
        w = np.where(who >= 0, np.maximum(near, 0.0), 0.0) ** POWER
        y = np.where(who >= 0, self.labels[np.maximum(who, 0)] if len(self.labels) else 0, 0)
        return np.log(((w * y).sum(axis=1) + self.prior) / ((w * (1 - y)).sum(axis=1) + 1 - self.prior))

    def score(self, texts: Rows, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, neighbours, cosines); ``skip`` as for the index."""
        who, near = self.index.nearest(texts, NEIGHBOURS, skip)
        z = self.line[0] * self.votes(who, near) + self.line[1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))), who, near


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and intercept of a weighted logistic regression of ``y`` on ``z``."""
    a = np.stack((z, np.ones(len(z))), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def relevance(terms: np.ndarray, row: np.ndarray, labels: np.ndarray, count: int) -> np.ndarray:
    """Square-root growth of a term's weight with its chi-squared, for terms that toxic examples hold more often."""
    a = np.bincount(terms[labels[row] == 1], minlength=count).astype(float)
    b = np.bincount(terms[labels[row] == 0], minlength=count).astype(float)
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    chi = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n0 + n1 - a - b) * n0 * n1, 1e-9)
    return np.sqrt(1.0 + np.where(a * n0 > b * n1, chi, 0.0) / RELEVANT)


def build_model(
    vocabulary: np.ndarray, idf: np.ndarray, ids: list, labels: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], shares: tuple[float, float]
) -> ToxicityModel:
    """``counts``: the examples' (offsets, terms, tf); ``shares``: the part of all training rows with label 0 and 1 that became examples."""
    offsets, terms, tf = counts
    row = np.repeat(np.arange(len(ids)), np.diff(offsets))
    weight = idf * relevance(terms, row, labels, len(vocabulary))
    x = Rows.of(offsets, terms, tf, weight)
    index = BlockIndex.build(x, len(vocabulary))
    each = 1.0 / np.array(shares)[labels] if len(labels) else np.zeros(0)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.01
    if len(np.unique(labels)) < 2:
        return ToxicityModel(vocabulary, weight, index, ids, labels, np.array([0.0, math.log(prior / (1 - prior))]), prior)
    model = ToxicityModel(vocabulary, weight, index, ids, labels, prior=prior)
    asked = np.unique(np.linspace(0, len(x) - 1, min(len(x), MAX_CALIBRATION)).astype(int))
    z = model.votes(*index.nearest(x.some(asked), NEIGHBOURS, asked))
    return ToxicityModel(vocabulary, weight, index, ids, labels, calibrate(z, labels[asked].astype(float), each[asked]), prior)


def choose_examples(labels: DataFrame, max_examples: tuple[int, int] = MAX_EXAMPLES) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, label) of the examples, and the shares of all training rows with label 0 and 1 that they are."""
    known = common.training_labels(labels, "toxic", 1 << 62)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = tuple(min(1.0, max_examples[k] / max(sizes.get(k, 0), 1)) for k in (0, 1))
    at = F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1_000_000))
    return known.where(at < F.when(F.col("label") == 1, int(shares[1] * 1_000_000)).otherwise(int(shares[0] * 1_000_000))), shares


def count_terms(documents: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """``documents`` with (terms, tf) in place of ``text``: the numbers (or hashes, without a vocabulary) of its terms, and their counts."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(vocabulary)  # terms of at most MAX_EXAMPLES texts
    kept = [c for c in documents.columns if c != "text"]
    kinds = dict(documents.dtypes)
    target = spark.createDataFrame([], ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", terms array<{'bigint' if vocabulary is None else 'int'}>, tf array<int>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        counter = TermCounter(held.value)
        for batch in batches:
            for rows in common.bounded_slices(batch, len(kept), SLICE_BYTES):
                offsets, *both = counter.counts(rows.column(len(kept)))
                edges = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, type=out.field(name).type.value_type)) for name, x in zip(("terms", "tf"), both, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(rows.columns[:-1], out, strict=False)), *(x.cast(out.field(n).type) for n, x in zip(("terms", "tf"), lists, strict=True))], schema=out)

    return documents.select(*kept, "text").mapInArrow(run, target)


@dataclass(frozen=True)
class Examples:
    """The examples' counts over their own terms, gathered on the driver (at most about ``MAX_EXAMPLES`` texts)."""

    vocabulary: np.ndarray
    ids: list
    labels: np.ndarray
    counts: tuple[np.ndarray, np.ndarray, np.ndarray]
    shares: tuple[float, float]

    @staticmethod
    def gather(documents: DataFrame, labels: DataFrame, max_examples: tuple[int, int]) -> Examples:
        chosen, shares = choose_examples(labels, max_examples)
        rows = count_terms(common.labelled_texts(documents, chosen), None).toArrow()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")])).combine_chunks()
        held = rows.column("terms").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int64()))
        offsets = held.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        vocabulary, terms = np.unique(held.flatten().to_numpy().view(np.uint64), return_inverse=True)
        tf = rows.column("tf").combine_chunks().flatten().to_numpy() if len(rows) else np.zeros(0, np.int32)
        # Hashes stand in another order in each text; numbers of the vocabulary rise within a text.
        order = np.lexsort((terms, np.repeat(np.arange(len(rows)), np.diff(offsets))))
        labels_ = rows.column("label").to_numpy().astype(np.int64)
        return Examples(vocabulary, rows.column("doc_id").to_pylist(), labels_, (offsets, terms[order], tf[order]), shares)


def fit_counts(counts: DataFrame, examples: Examples) -> ToxicityModel:
    """The model of ``examples``, with document frequencies of all rows of ``counts``."""
    df = np.zeros(len(examples.vocabulary))
    spread = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toPandas()  # a row for each term
    df[spread["term"].to_numpy(np.int64)] = spread["n"].to_numpy()
    idf = np.log(1.0 + counts.count() / (df + 1.0))
    return build_model(examples.vocabulary, idf, examples.ids, examples.labels, examples.counts, examples.shares)


def fit(documents: DataFrame, labels: DataFrame, max_examples: tuple[int, int] = MAX_EXAMPLES) -> ToxicityModel:
    """Learn from labelled texts outside the held-out fold; document frequencies are of all documents.

    Ids of any type; a repeated id is one example, null ids and labels are left out, a null
    text is an example without terms.
    """
    examples = Examples.gather(documents, labels, max_examples)
    return fit_counts(count_terms(documents.select("doc_id", "text"), examples.vocabulary), examples)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, evidence), one row for each row of ``documents``.

    ``evidence`` are the nearest examples (example, label, similarity), nearest first; a
    row's own id is never among its neighbours, so its own label is no input.  Null and
    empty texts have no neighbours and get the calibrated prior; repeated rows each get a
    row; an empty table gives an empty table; without labelled examples of both kinds all
    scores are the prior.  Columns other than doc_id and text are ignored.
    """
    return score_counts(count_terms(documents.select("doc_id", "text"), model.vocabulary), model)


def score_counts(counts: DataFrame, model: ToxicityModel) -> DataFrame:
    """``score`` for texts that are counted already."""
    spark = counts.sparkSession
    kind = dict(counts.dtypes)["doc_id"]
    held = spark.sparkContext.broadcast(model)  # at most MAX_EXAMPLES texts
    target = spark.createDataFrame([], f"doc_id {kind}, score double, evidence array<struct<example:{kind},label:int,similarity:double>>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        m = held.value
        number = {x: i for i, x in enumerate(m.ids)}
        kinds = out.field("evidence").type.value_type
        ids = pa.array(m.ids, type=kinds.field("example").type)
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * QUERIES):
                part = batch.slice(start, 4 * QUERIES)
                terms, tf = (part.column(i) for i in (1, 2))
                edges = terms.offsets.to_numpy().astype(np.int64)
                flat = terms.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]].astype(np.int64)
                times = tf.values.to_numpy(zero_copy_only=False)[int(tf.offsets[0].as_py()) : int(tf.offsets[-1].as_py())]
                skip = np.array([number.get(x, -1) for x in part.column(0).to_pylist()], dtype=np.int64)
                scores, who, near = m.score(Rows.of(edges - edges[0], flat, times, m.weight), skip)
                shown = (who[:, :5] >= 0) & (near[:, :5] > 0)
                chosen = who[:, :5][shown]
                rows = pa.StructArray.from_arrays(
                    [ids.take(pa.array(chosen)), pa.array(m.labels[chosen], pa.int32()), pa.array(near[:, :5][shown], pa.float64())], fields=list(kinds)
                )
                offsets = pa.array(np.concatenate(([0], np.cumsum(shown.sum(axis=1)))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.ListArray.from_arrays(offsets, rows).cast(out.field("evidence").type)], schema=out)

    return counts.select("doc_id", "terms", "tf").mapInArrow(run, target)


def score_all(documents: DataFrame, labels: DataFrame, max_examples: tuple[int, int] = MAX_EXAMPLES) -> DataFrame:
    """Fit on ``documents`` and score them; texts are split once for the examples and once for the counts."""
    examples = Examples.gather(documents, labels, max_examples)
    counts = common.materialize(count_terms(documents.select("doc_id", "text"), examples.vocabulary))
    return score_counts(counts, fit_counts(counts, examples))
