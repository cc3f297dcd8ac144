"""Language identification by mixture inference: each document is a mixture of languages.

Training counts hashed byte trigrams per language over all training rows, in Spark. A document's trigrams are then
explained by a mixture of the learned distributions: expectation-maximisation estimates the share of each language;
languages are ordered by share, and the set of the first k is chosen for which the mixture's log-likelihood, less a
penalty per language, is greatest. The prediction is the language of the largest share in that set, the score its share.

The model has ``BUCKETS`` numbers per language and goes to the tasks whole; nothing else is broadcast.

Defined results: ``und`` with score 0 for texts that are null or have no letter (and where nothing could be learned);
rows with null text or null language are not learned from; ties go to the language that sorts first; an empty table
gives an empty result; lang, source and doc_id never enter a prediction; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import python_batches, tidy

UNDETERMINED = "und"
BUCKETS = 1 << 15
_ROUNDS = 12
_PENALTY = 4.0  # times log(number of trigrams), for each further language
_SMOOTHING = 0.5
_HELD_LANGUAGES = 64  # counted at a time by one task
_letter = regex.compile(r"\p{L}").search
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))


def grams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lowered text, other ASCII than letters as spaces; none without a letter."""
    if not text or not _letter(text):
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    whole = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((whole * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-free probabilities [language, bucket] from rows with text and lang."""
    python_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            parts = [(lang, np.flatnonzero(n), n) for lang, n in held.items()]
            return pd.DataFrame({
                "lang": np.repeat(np.array([p[0] for p in parts], object), [len(p[1]) for p in parts]),
                "bucket": np.concatenate([p[1] for p in parts]).astype(np.int32), "n": np.concatenate([p[2][p[1]] for p in parts]),
            })

        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                if lang not in held and len(held) >= _HELD_LANGUAGES:
                    yield rows()
                    held.clear()
                found = np.concatenate([grams(t) for t in texts])
                held[lang] = held.get(lang, 0) + np.bincount(found, minlength=BUCKETS)
        if held:
            yield rows()

    learned = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = learned.mapInPandas(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most BUCKETS rows per language
    languages = sorted(found["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    table[np.searchsorted(languages, found["lang"].to_numpy(str)) if languages else [], found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    table += _SMOOTHING
    return languages, (table / table.sum(axis=1, keepdims=True)).astype(np.float32) if languages else table.astype(np.float32)


def _em(p: np.ndarray, count: np.ndarray, doc: np.ndarray, offsets: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares [doc, language] after ``rounds`` steps, and log-likelihoods under the shares before the last step."""
    total = np.add.reduceat(count, offsets)
    fit = np.zeros(len(share))
    for k in range(rounds):
        part = p * share[doc]
        whole = part.sum(axis=1)
        if k == rounds - 1:
            fit = np.add.reduceat(np.log(whole) * count, offsets)
        part *= (count / whole)[:, None]
        share = np.add.reduceat(part, offsets, axis=0) / total[:, None]
    return share, fit


def mixtures(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the predicted language (-1: none) and its share, per text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    found = [np.unique(g, return_counts=True) for g in map(grams, texts)]
    index = np.array([i for i, (b, _) in enumerate(found) if len(b)], int)
    if not len(index) or not len(table):
        return best, score
    sizes = np.array([len(found[i][0]) for i in index])
    offsets = np.cumsum(sizes) - sizes
    count = np.concatenate([found[i][1] for i in index]).astype(np.float32)
    doc = np.repeat(np.arange(len(index)), sizes)
    p = np.ascontiguousarray(table[:, np.concatenate([found[i][0] for i in index])].T)
    n = np.add.reduceat(count, offsets)
    full, _ = _em(p, count, doc, offsets, np.full((len(index), len(table)), 1 / len(table), np.float32), _ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    chosen, value = full, np.full(len(index), -np.inf)
    for k in range(1, len(table) + 1):
        inside = np.zeros(full.shape, bool)
        np.put_along_axis(inside, order[:, :k], True, axis=1)
        start = np.where(inside, np.maximum(full, 1e-6), 0)
        start = (start / start.sum(axis=1, keepdims=True)).astype(np.float32)
        share, fit = _em(p, count, doc, offsets, start, 1 if k == 1 else _ROUNDS // 2)
        fit = fit - _PENALTY * k * np.log(n)
        better = fit > value
        chosen, value = np.where(better[:, None], share, chosen), np.where(better, fit, value)
    best[index] = chosen.argmax(axis=1)
    score[index] = np.minimum(chosen.max(axis=1), np.take_along_axis(full, chosen.argmax(axis=1)[:, None], 1)[:, 0]).clip(0, 1)
    return best, score


_PART_CHARS = 250_000  # characters explained at a time


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus the predicted language and its share. Clashing names are replaced."""
    python_batches(docs.sparkSession)
    names = np.array([*languages, UNDETERMINED], object)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, best, score, at, held = batch.tolist(), [], [], 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held > _PART_CHARS or i == len(texts) - 1:
                    b, s = mixtures(texts[at : i + 1], table)
                    best.append(b)
                    score.append(s)
                    at, held = i + 1, 0
            yield pd.DataFrame({"lang_pred": names[np.concatenate(best)] if best else [], "score": np.concatenate(score) if score else np.empty(0)})

    found = F.pandas_udf(tidy(run), "lang_pred string, score double")(F.col("text"))
    return docs.withColumn("_found", found).withColumns({out[0]: F.col("_found.lang_pred"), out[1]: F.col("_found.score")}).drop("_found")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
