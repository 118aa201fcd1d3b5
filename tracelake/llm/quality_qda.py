"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics.  Class covariances are
shrunk towards the pooled covariance and a scaled identity; the score is the
logistic of the difference of the two Gaussian log densities (Mahalanobis
distances from cached Cholesky factors) plus the log prior odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common

#: Labelled rows that a fit reads at most (about; the choice is by hash).
MAX_TRAINING_ROWS = 20_000
STATISTICS = (
    "log_words", "word_length", "upper", "symbols", "marks", "bangs", "digits", "high_bytes", "types", "top_word",
    "pair_types", "repeated_lines", "line_words",
)
#: Least variance of a statistic.
FLOOR = 1e-6
_SYMBOLS = np.frombuffer(b"#*$%&|<>=~^\\{}[]@_", dtype=np.uint8)
_MARKS = np.frombuffer(b".,;:?-'\"()/", dtype=np.uint8)


def _odds(count: float, of: float, usual: float, weight: float = 30.0) -> float:
    """Log odds of a share; ``weight`` pseudo-counts at the usual share keep short texts near it."""
    share = (count + usual * weight) / (of + weight)
    return math.log((share + 2e-3) / (1.0 - share + 2e-3))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    size = max(len(data), 1)
    space = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    solid = max(len(data) - space, 1)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n),
        math.log((solid + 25.0) / (n + 5.0)),
        _odds(upper, upper + lower, 0.04),
        _odds(int(counts[_SYMBOLS].sum()), solid, 0.0),
        _odds(int(counts[_MARKS].sum()), solid, 0.04),
        _odds(int(counts[33]), solid, 0.0),
        _odds(int(counts[48:58].sum()), solid, 0.0),
        _odds(int(counts[128:].sum()), size, 0.02),
        math.log(len(tally) + 10.0) - math.log(n + 10.0) * 0.9,
        _odds(max(tally.values(), default=0), n, 0.06),
        _odds(pairs, max(n - 1, 1), 0.98),
        _odds(len(lines) - len(set(lines)), len(lines), 0.0, 5.0),
        math.log((n + 10.0) / (len(lines) + 1.0)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    inverse_factor: np.ndarray  # inverse of the Cholesky factor
    log_norm: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse_factor.T
        return -0.5 * np.einsum("ij,ij->i", z, z) - self.log_norm


@dataclass(frozen=True)
class QualityModel:
    """``scale`` and ``shift`` map the log-density difference to log odds."""

    classes: tuple[Gaussian, Gaussian] | None
    shift: float
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            margin = np.full(len(x), self.shift)
        else:
            margin = self.shift + self.scale * (self.classes[1].log_density(x) - self.classes[0].log_density(x))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -60.0, 60.0)))


def _gaussian(moments: tuple[float, np.ndarray, np.ndarray], pooled: np.ndarray, shrink: float, ridge: float) -> Gaussian:
    n, total, square = moments
    mean = total / n
    own = square / n - np.outer(mean, mean)
    cov = (1 - shrink) * own + shrink * pooled
    # The floor keeps the factor where all texts are alike.
    cov = (1 - ridge) * cov + max(ridge * np.trace(pooled) / len(mean), FLOOR) * np.eye(len(mean))
    factor = np.linalg.cholesky(cov)
    return Gaussian(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))


def fit_matrix(x: np.ndarray, y: np.ndarray, shrink: float = 0.3, ridge: float = 0.02, scale: float = 0.5) -> QualityModel:
    """Fit on statistics ``x`` and 0/1 labels ``y``; with one class only, the prior."""
    prior = math.log((float((y == 1).sum()) + 1.0) / (float((y == 0).sum()) + 1.0)) if len(y) else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return QualityModel(None, prior)
    parts = [(float((y == k).sum()), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)]
    within = [s / n - np.outer(t / n, t / n) for n, t, s in parts]
    pooled = sum(n * w for (n, _, _), w in zip(parts, within, strict=True)) / len(y)
    return QualityModel((_gaussian(parts[0], pooled, shrink, ridge), _gaussian(parts[1], pooled, shrink, ridge)), prior, scale)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> QualityModel:
    """Fit on about ``max_rows`` labelled documents outside the held-out fold, ids of any type.

    Null ids and labels are left out, a null text counts as empty, a repeated id is one row;
    without rows of both labels the model is the prior.  Columns other than doc_id, text and quality are ignored.
    """
    rows = common.labelled_texts(documents, common.training_labels(labels, "quality", max_rows)).select("label", "text")

    def work(c: dict[str, list]) -> dict[str, list]:
        return {"label": c["label"], "x": matrix(c["text"]).tolist()}

    found = common.map_batches(rows, work, "label int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(STATISTICS))
    order = np.lexsort((*x.T, found["label"].to_numpy())) if len(x) else []
    return fit_matrix(x[order], found["label"].to_numpy(dtype=np.int64)[order]) if len(x) else fit_matrix(x, np.zeros(0))


def score(documents: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "quality_score") -> DataFrame:
    """``keep`` columns and the score (0 to 1, higher: better) as ``name`` for each row.

    Null and empty texts are scored as empty texts, repeated rows each get their
    row, an empty table gives an empty table; other columns are ignored.
    """
    rows = documents.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = dict(rows.dtypes)

    def work(c: dict[str, list]) -> dict[str, list]:
        return {k: c[k] for k in keep} | {name: model.score(matrix(c["text"])).tolist()}

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return common.map_batches(rows, work, f"{schema}, {name} double")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with all their columns, whatever their names.

    Null and empty texts are judged as empty texts, equal rows alike; without labels of both kinds
    the prior decides for all.  An empty table stays empty.
    """
    model = fit(documents, labels)
    columns = tuple(documents.columns)
    name = "quality_score"
    while name in columns:
        name += "_"
    return score(documents, model, columns, name).where(F.col(name) >= threshold).select(*columns)
