"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough: the negatives' share of the risk is what the
unlabelled risk leaves after the positives' part, weighted by the class prior, is taken out. That
estimate can turn negative when the model fits the sample too closely; the non-negative risk stops
it at zero (steps that would drive it below zero are undone instead). With the logistic loss the
score estimates the probability of a good text.

The model is linear over surface features of the whole text: the byte profile, the make-up of
words and their repetition. It is fitted on bounded samples (``SAMPLE`` rows each) and scores every
row in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import remainder
from driftline.llm.textbatch import Block, blocks, word_hashes

# Rows of each training sample.
SAMPLE = 6000
THRESHOLD = 0.3
FOLDS = 5
SEED = 5

_KIND = np.zeros(256, np.int64)  # 0: other ASCII signs
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[[9, 11, 12, 13, 32]] = 5
_KIND[10] = 6
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 7
_KINDS = 8
FEATURES = 256 + _KINDS + 3 * _KINDS + 13


def features(block: Block) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text of the block."""
    n, data = len(block), block.data
    owner = block.owner()
    size = np.maximum(block.ends - block.starts, 1)[:, None]
    bytes_ = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    bytes_[:, 10] -= 1  # the block's own newline
    kinds = np.zeros((n, _KINDS))
    np.add.at(kinds.T, _KIND, bytes_.T)

    starts, ends = block.words()
    of = owner[starts]
    count = np.bincount(of, minlength=n).astype(float)
    words = np.maximum(count, 1)
    hashes = word_hashes(data, starts, ends)
    long = ends - starts

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n) / words

    def kinds_at(place: np.ndarray) -> np.ndarray:
        return np.bincount(of * _KINDS + _KIND[data[place]], minlength=n * _KINDS).reshape(n, _KINDS) / words[:, None]

    same_text = of[1:] == of[:-1]
    repeated = np.concatenate(([False], same_text & (hashes[1:] == hashes[:-1]))) if len(of) else np.zeros(0, bool)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(of), bool)
    if len(of):
        fresh[1:] = (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n) / words
    mean = np.bincount(of, weights=long, minlength=n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, weights=long.astype(float) ** 2, minlength=n) / words - mean**2, 0))
    again = share(repeated)
    parts = (
        np.sqrt(bytes_ / size),
        kinds / size,
        kinds_at(starts),
        kinds_at(ends - 1),
        kinds_at((starts + ends) // 2),
        np.stack([again, distinct, share(long == 1), share(long > 20), mean / 10, spread / 10,
                  np.log1p(count) / 10, np.sqrt(kinds[:, 6] / words),
                  again > 0.1, again > 0.25, again > 0.5, np.sqrt(again), distinct < 0.3], axis=1),
    )
    return np.concatenate(parts, axis=1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def constant(prior: float) -> Model:
    return Model(np.zeros(FEATURES), float(np.log(prior / (1 - prior))), np.zeros(FEATURES), np.ones(FEATURES), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Minimises the non-negative unbiased risk of the logistic loss by Adam over mini-batches."""
    if not len(positive) or not len(unlabelled):
        return constant(prior)
    centre, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(SEED)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    tail = steps // 4

    def sigmoid(f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))

    def slope(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(by @ x, by.sum()) / len(x)

    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
        fp, fu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        # log(1 + e^f) is the loss of f as a negative; its slope is the sigmoid.
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        as_negative = slope(xu, sigmoid(fu)) - prior * slope(xp, sigmoid(fp))
        grad = prior * slope(xp, sigmoid(fp) - 1) + as_negative if negative >= 0 else -as_negative
        grad[:-1] += decay * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if step > steps - tail:
            total += w
    w = total / tail
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def _sampled(rows: DataFrame, limit: int, salt: int) -> np.ndarray:
    """Features of about ``limit`` seeded rows of ``rows(__id, __t)`` at most ``2 * limit``, in id order."""
    count = rows.select("__id").count()
    if not count:
        return np.zeros((0, FEATURES))
    if count > limit:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(salt), "__id"), F.lit(1 << 20)) < int((1 << 20) * limit / count) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.concatenate([features(b) for b in blocks(batch["__t"])]) if len(batch) else np.zeros((0, FEATURES))
            yield pd.DataFrame({"id": batch["__id"].astype(str), "x": [row.astype(np.float32).tobytes() for row in x]})

    got = sorted(tuple(r) for r in rows.mapInPandas(run, "id string, x binary").limit(2 * limit).collect())
    return np.frombuffer(b"".join(bytes(x) for _, x in got), np.float32).reshape(-1, FEATURES).astype(float)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the rows outside the held-out fold (crc32 of the key mod 5 is not 0, key not null).

    Positives are the texts labelled 1. The unlabelled sample is drawn from all texts outside the
    fold, whatever their label. The prior is the share of 1 among the labels outside the fold, at
    least 0.05 and at most 0.95. A text with a 1 and a 0 counts once for each; null labels and null
    keys are no labels. Without positives every text scores the prior (0.5 without labels).
    """
    texts = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    texts = texts.where(remainder(F.col("__id"), FOLDS) != 0)
    known = labels.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{label}`").alias("__y"))
    known = known.where(F.col("__y").isin(0, 1) & (remainder(F.col("__id"), FOLDS) != 0)).distinct()
    share = known.agg(F.avg("__y")).first()[0]
    prior = 0.5 if share is None else min(0.95, max(0.05, float(share)))
    good = known.where("__y = 1").select("__id")
    count = good.count()
    if count > sample:  # fewer ids first, so that few texts are looked up
        rate = int((1 << 20) * sample / count) + 1
        good = good.where(F.pmod(F.xxhash64(F.lit(SEED), "__id"), F.lit(1 << 20)) < rate)
        texts_of_good = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "__id"), F.lit(1 << 20)) < rate)
    else:
        texts_of_good = texts
    positive = _sampled(texts_of_good.join(good, "__id", "left_semi"), sample, SEED + 1)
    unlabelled = _sampled(texts, sample, SEED + 2)
    return fit(positive, unlabelled, prior)


def score_column(model: Model, text: str = "text") -> Column:
    """The model's score of a text column, in numpy batches; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(features(b)) for b in blocks(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(f"`{text}`"))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, ``held_out, score, predicted``.

    ``held_out`` marks the fold that ``train`` leaves out (false for a null key). Null and empty
    texts are scored as empty; equal texts get equal scores. An empty table gives no rows; other
    columns are ignored.
    """
    marked = docs.select(
        F.col(f"`{key}`"),
        F.coalesce(remainder(F.col(f"`{key}`"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        score_column(model, text).alias("score"),
    )
    return marked.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns of ``docs``."""
    return docs.where(score_column(model, text) >= threshold)
