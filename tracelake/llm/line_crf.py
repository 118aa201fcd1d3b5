"""Quality rules with line sequence labelling.

A linear-chain conditional random field with two states labels every line that
has a word as content or boilerplate; Viterbi decoding picks the best path, and
the share of word characters in content lines decides whether a text is kept.

Lines carry no labels of their own, so training is distant: a line is
boilerplate if its text is labelled bad or if it repeats an earlier line of the
text; all else is content.  State and transition weights are those of the greatest
penalised conditional likelihood, by forward and backward sums and quasi-Newton
steps.  (Lines that many documents hold were tried as boilerplate too: good texts of
one short line then look like boilerplate, and 2 % of the good texts are lost.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common

#: Labelled texts that a fit reads at most (about), and lines of each: of a longer text, so many at a place chosen by hash.
MAX_TRAINING_TEXTS, MAX_TRAINING_LINES = 4_000, 128
MIN_WORDS = 10
MAX_REPEATED = 20  # words in repeated windows, in hundredths of the words
MIN_CONTENT_SHARE = 0.5
WINDOW = 5
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[list(b"!")] = 6
_CLASS[list(b".,;:?-'\"()/")] = 7
_CLASS[list(b" \t\n\v\f\r")] = 8
_FEATURES = 10


def _shares(x: np.ndarray, of: np.ndarray, usual: float, weight: float = 15.0) -> np.ndarray:
    share = (x + usual * weight) / (of + weight)
    return np.log((share + 5e-3) / (1.0 - share + 5e-3))


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, word characters in bytes, features) of the lines with a word."""
    lines = data.split(b"\n")
    sizes = np.fromiter((len(x) for x in lines), dtype=np.int64, count=len(lines))
    words = [x.split() for x in lines]
    n_words = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(lines))
    at = np.flatnonzero(n_words)
    if not len(at):
        return at, at, np.zeros((0, _FEATURES))
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    # A line with a word has a byte, so its start is a valid place to reduce from;
    # newlines between count as class 8, which is never read.
    per = [np.add.reduceat(kinds == k, starts[at], dtype=np.int64) for k in range(1, 8)]
    solid = sum(per) + np.add.reduceat(kinds == 0, starts[at], dtype=np.int64)
    n = n_words[at].astype(np.float64)
    distinct = np.fromiter((len(set(words[i])) for i in at), dtype=np.int64, count=len(at))
    seen: set[bytes] = set()
    again = np.zeros(len(at))
    for j, i in enumerate(at):
        again[j] = lines[i] in seen
        seen.add(lines[i])
    x = np.empty((len(at), _FEATURES))
    x[:, 0] = 1.0
    x[:, 1] = np.log1p(n)
    x[:, 2] = np.log((solid + 15.0) / (n + 3.0))
    x[:, 3] = _shares(per[1], per[0] + per[1], 0.04)
    x[:, 4] = _shares(per[4], solid, 0.0)
    x[:, 5] = _shares(per[5], solid, 0.0)
    x[:, 6] = _shares(per[2], solid, 0.0)
    x[:, 7] = _shares(per[6], solid, 0.04)
    x[:, 8] = _shares(n - distinct, n, 0.1, 5.0)
    x[:, 9] = again
    return at, solid, x


@dataclass(frozen=True)
class LineField:
    """State weights for content against boilerplate and 2 x 2 transition weights (0 boilerplate, 1 content)."""

    weights: np.ndarray
    transitions: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best path of 0 (boilerplate) and 1 (content); a tie is content."""
        gain = x @ self.weights
        (bb, bc), (cb, cc) = self.transitions.tolist()
        back_b, back_c = np.zeros(len(gain), dtype=np.int8), np.zeros(len(gain), dtype=np.int8)
        b, c = 0.0, float(gain[0])
        for t, g in enumerate(gain[1:].tolist(), 1):
            back_b[t] = c + cb >= b + bb
            back_c[t] = c + cc >= b + bc
            b, c = max(c + cb, b + bb), max(c + cc, b + bc) + g
        path = np.empty(len(gain), dtype=np.int8)
        path[-1] = c >= b
        for t in range(len(gain) - 1, 0, -1):
            path[t - 1] = back_c[t] if path[t] else back_b[t]
        return path


Sequence = tuple[np.ndarray, np.ndarray, float]  # features of its lines, their labels, its weight


def likelihood(weights: np.ndarray, transitions: np.ndarray, x: np.ndarray, y: np.ndarray, cuts: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted conditional log likelihood of label sequences, and its gradients by state and transition weights.

    The sequences stand one after the other in ``x`` and ``y``, longest first, cut at ``cuts``.
    The sums go forwards and backwards over all sequences at once.
    """
    lengths = np.diff(cuts)
    gain = x @ weights
    alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    alpha[cuts[:-1], 1] = gain[cuts[:-1]]
    active = [int((lengths > t).sum()) for t in range(1, int(lengths.max(initial=0)))]
    for t, k in enumerate(active, 1):
        at = cuts[:k] + t
        step = alpha[at - 1][:, :, None] + transitions
        alpha[at] = np.logaddexp(step[:, 0], step[:, 1])
        alpha[at, 1] += gain[at]
    for t, k in reversed(list(enumerate(active, 1))):
        at = cuts[:k] + t
        ahead = beta[at].copy()
        ahead[:, 1] += gain[at]
        step = transitions + ahead[:, None, :]
        beta[at - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    ends = cuts[1:] - 1
    total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    each = np.repeat(np.arange(len(lengths)), lengths)
    w = weight[each]
    p = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - total[each], None, 0))
    inner = np.ones(len(x), dtype=bool)
    inner[cuts[:-1]] = False
    later = np.flatnonzero(inner)
    ahead = beta[later].copy()
    ahead[:, 1] += gain[later]
    both = np.exp(alpha[later - 1][:, :, None] + transitions + ahead[:, None, :] - total[each[later]][:, None, None])
    moves = np.zeros((2, 2))
    np.add.at(moves, (y[later - 1], y[later]), w[later])
    value = float((w * gain * y).sum() + (moves * transitions).sum() - (weight * total).sum())
    return value, x.T @ (w * (y - p)), moves - (both * w[later][:, None, None]).sum(axis=0)


def climb(f, start: np.ndarray, rounds: int = 80) -> np.ndarray:  # noqa: ANN001
    """The greatest value of a concave function that gives (value, gradient), by quasi-Newton (BFGS) steps."""
    at, (value, slope) = start, f(start)
    inverse = np.eye(len(start)) / max(1.0, float(np.linalg.norm(slope)))
    for _ in range(rounds):
        way = inverse @ slope
        if way @ slope <= 1e-9 * max(1.0, abs(value)):
            break
        size = 1.0
        while size > 1e-6:
            to = at + size * way
            next_value, next_slope = f(to)
            if next_value >= value + 1e-4 * size * (way @ slope):
                break
            size /= 2
        else:
            break
        s, d = to - at, slope - next_slope
        if (sd := s @ d) > 1e-12:
            keep = np.eye(len(s)) - np.outer(s, d) / sd
            inverse = keep @ inverse @ keep.T + np.outer(s, s) / sd
        at, value, slope = to, next_value, next_slope
    return at


def fit_sequences(sequences: list[Sequence], penalty: float = 1.0) -> LineField:
    """The field of the greatest penalised likelihood.  Without lines of both labels every line is content."""
    some = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    y = np.concatenate([s[1] for s in some]).astype(int) if some else np.zeros(0, int)
    if not 0 < y.sum() < len(y):
        return LineField(np.eye(_FEATURES)[0], np.zeros((2, 2)))
    x = np.concatenate([s[0] for s in some]).astype(np.float64)
    mean, spread = x[:, 1:].mean(axis=0), np.maximum(x[:, 1:].std(axis=0), 1e-6)
    x[:, 1:] = (x[:, 1:] - mean) / spread
    cuts = np.concatenate(([0], np.cumsum([len(s[1]) for s in some])))
    weight = np.array([s[2] for s in some])

    def f(at: np.ndarray) -> tuple[float, np.ndarray]:
        value, states, moves = likelihood(at[:_FEATURES], at[_FEATURES:].reshape(2, 2), x, y, cuts, weight)
        return value - 0.5 * penalty * at @ at, np.concatenate((states, moves.ravel())) - penalty * at

    at = climb(f, np.zeros(_FEATURES + 4))
    w = at[:_FEATURES].copy()
    w[1:] /= spread
    w[0] -= w[1:] @ mean
    return LineField(w, at[_FEATURES:].reshape(2, 2))


def training_lines(documents: DataFrame, labels: DataFrame, max_texts: int = MAX_TRAINING_TEXTS) -> DataFrame:
    """(label, features) of the lines with a word of about ``max_texts`` labelled texts outside the held-out fold."""
    texts = common.labelled_texts(documents, common.training_labels(labels, "quality", max_texts)).select("label", "text")

    def work(c: dict[str, list]) -> dict[str, list]:
        found = []
        for text in c["text"]:
            data = (text or "").encode("utf-8", "replace")
            x = line_features(data)[2]
            over = len(x) - MAX_TRAINING_LINES
            start = xxhash.xxh64_intdigest(data) % (over + 1) if over > 0 else 0
            found.append(x[start : start + MAX_TRAINING_LINES].astype(np.float32).tobytes())
        return {"label": c["label"], "features": found}

    return common.map_batches(texts, work, "label int, features binary")


def fit(documents: DataFrame, labels: DataFrame, max_texts: int = MAX_TRAINING_TEXTS) -> LineField:
    """Train on lines of about ``max_texts`` labelled texts outside the held-out fold, ids of any type.

    The driver gets the lines' features, at most ``MAX_TRAINING_LINES`` for each text, and no text.  Good and bad
    texts weigh the same in all.  A repeated id is one text; null ids and labels are left out, a null text has no
    lines; without lines of both labels every line is content.  Other columns are ignored.
    """
    found = training_lines(documents, labels, max_texts).toPandas()
    sequences: list[Sequence] = []
    for label, features in zip(found["label"], found["features"], strict=True):
        x = np.frombuffer(features, np.float32).reshape(-1, _FEATURES)
        sequences.append((x, ((label == 1) & (x[:, -1] == 0)).astype(int), float(label)))
    sequences.sort(key=lambda s: (len(s[1]), s[2], s[0].tobytes()))
    lines = [sum(len(s[1]) for s in sequences if s[2] == k) for k in (0, 1)]
    return fit_sequences([(x, y, 0.5 * sum(lines) / max(1, lines[int(k)])) for x, y, k in sequences])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window that occurs at least twice, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    if len(numbers) == len(words):
        return 0
    # Windows are numbered exactly: a window of k+1 words is the pair of a window of k words and a word.
    code = ids[:n]
    for k in range(1, window):
        code = code * np.uint64(len(numbers)) + ids[k : k + n]
        if k < window - 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    covered[:n] += again
    covered[window:] -= again
    return int((np.cumsum(covered[:-1]) > 0).sum())


def judge(text: str | None, field: LineField) -> dict:
    """Counts, line labels (C content, B boilerplate, - no word) and verdict of one whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    white = sum(data.count(x) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in data.split(b"\n") if x.split()]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    at, solid, x = line_features(data)
    path = field.viterbi(x) if len(x) else np.zeros(0, dtype=np.int8)
    share = float(solid[path == 1].sum() / solid.sum()) if len(x) else 0.0
    tags = bytearray(b"-" * (data.count(b"\n") + 1))
    for i, p in zip(at.tolist(), path.tolist(), strict=True):
        tags[i] = 67 if p else 66
    return {
        "n_words": len(words),
        "word_chars": len(text) - white,
        "n_symbols": sum(data.count(bytes([s])) for s in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": not failed and share >= MIN_CONTENT_SHARE,
        "content_share": share,
        "line_labels": tags.decode(),
    }


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, content_share double, line_labels string"
)


def label_lines(documents: DataFrame, field: LineField) -> DataFrame:
    """One row for each row of ``documents``: doc_id, counts, verdict and line labels.

    A null text counts as empty: no words, base_failed, not kept.  Repeated rows
    and ids give a row each, an empty table an empty table; columns other than
    doc_id and text are ignored.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def work(c: dict[str, list]) -> dict[str, list]:
        found = [judge(t, field) for t in c["text"]]
        return {"doc_id": c["doc_id"]} | {k: [x[k] for x in found] for k in (found[0] if found else ())}

    return common.map_batches(documents.select("doc_id", "text"), work, f"doc_id {kind}, {SCHEMA}")
