"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text (lengths, shares of kinds of characters, repetition of words, pairs and lines) are taken
through logarithms. Counts, sums and products per class are folded by Spark over all training rows, so that only two
rows of sums reach the driver. Each class covariance is shrunk towards the pooled one and a multiple of the identity;
its Cholesky factor is kept, and a score is the logistic of the difference of the two log densities and priors, with
Mahalanobis distances from triangular solves.

Defined results: null and empty texts get all statistics of an empty text and so a score; documents without a label or
with a null one are scored but not learned from; a document labelled twice counts twice; with fewer than two classes
the score is the share of label 1 (0.5 with no label at all); an empty table gives an empty result; labels, lang, source
and doc_id never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import id_number, id_text, python_batches
from curbline.session import cut

_TOWARDS_POOLED, _TOWARDS_ROUND = 0.1, 0.05
_SYMBOLS = bytes(set(range(33, 127)) - set(b".,;:'\"-()?") - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"
_HIGH = bytes(range(128, 256))
FEATURES = 16


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w = len(raw), len(words)

    def share(kind: bytes) -> float:
        return (n - len(raw.translate(None, kind))) / n if n else 0.0

    def log_share(x: float) -> float:
        return float(np.log(x + 0.002))

    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:]))
    sizes = np.fromiter(map(len, words), float, w) if w else np.zeros(1)
    upper = sum(1 for x in words if x.isupper() and len(x) > 1)
    return [
        float(np.log1p(w)), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), len(seen) / np.sqrt(2 * w) if w else 0.0,
        float(np.log((len(pairs) + 1) / max(w, 1))), log_share(seen.most_common(1)[0][1] / w if w else 0.0), log_share(same / w if w else 0.0), log_share(1 - len(set(lines)) / len(lines) if lines else 0.0),
        log_share(share(_SYMBOLS)), log_share(share(_UPPER)), log_share(share(_DIGITS)), log_share(share(_MARKS)), log_share(upper / w if w else 0.0),
        float(np.log1p(n / max(len(lines), 1))), log_share(sum(x[-1:] in b".!?" for x in words) / w if w else 0.0), log_share(sum(not x.strip(_MARKS + b"'\"-()").isalpha() and max(x) < 128 for x in words) / w if w else 0.0),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats per row of ``docs`` (doc_id, text), written."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "stats": [statistics(t) for t in batch["text"]]})

    return cut(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, stats array<double>").withColumn("doc_id", id_number()))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, log prior less half the log determinant."""

    means: tuple[np.ndarray, ...]
    whiteners: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), self.share)
        dense = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiteners, self.constants)]
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -50, 50)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From all rows of ``labels`` (doc_id, label 0/1) that have statistics."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for batch in batches:
            x, y = np.stack(batch["stats"].to_list()) if len(batch) else np.zeros((0, FEATURES)), batch["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pd.DataFrame({"label": np.repeat([0, 1], sums.shape[1]), "place": np.tile(np.arange(sums.shape[1]), 2), "value": sums.ravel()})

    labelled = stats.join(labels.where(F.col("label").isin(0, 1)).select("doc_id", "label"), "doc_id").select("stats", "label")
    folded = labelled.mapInPandas(fold, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for label, place, value in folded.collect():  # two rows of sums, spread over places
        sums[label, place] = value
    n = sums[:, 0]
    if not n.all():
        return Discriminant((), (), (), float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 1 : 1 + FEATURES] / n[:, None]
    spread = [sums[k, 1 + FEATURES :].reshape(FEATURES, FEATURES) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    whiteners, constants = [], []
    for k in (0, 1):
        cov = (1 - _TOWARDS_POOLED) * spread[k] + _TOWARDS_POOLED * pooled
        cov = (1 - _TOWARDS_ROUND) * cov + _TOWARDS_ROUND * np.diag(scale**2)  # the identity, in units of the pooled spread
        factor = np.linalg.cholesky(cov)
        whiteners.append(np.linalg.inv(factor))
        constants.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(whiteners), tuple(constants), float(n[1] / n.sum()))


def scored(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted per row of ``stats``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(np.stack(batch["stats"].to_list())) if len(batch) else np.empty(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return stats.select(id_text(), "stats").mapInPandas(run, "doc_id string, score double, predicted int").withColumn("doc_id", id_number())
