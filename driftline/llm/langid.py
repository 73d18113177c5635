"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte 3- and 4-grams (hashed into ``BUCKETS``
buckets), and a linear softmax over that average gives the language. Both are trained together by
stochastic gradient descent in numpy, on a bounded sample. Part of the sample calibrates the
scores (a temperature) and the score below which an answer should be rejected.

Embedding and softmax are both linear, so every bucket is scored once after training, and a text
costs one table row per gram, in numpy batches over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import remainder, stored
from driftline.llm.textbatch import Block, blocks

# Training rows in all, shared out evenly over the languages, but so many of each at least: the sample
# grows with the number of languages. A row sends at most four bytes per bucket to the driver.
SAMPLE = 3200
EACH = 16
# Languages a model may have: each is a column of the score table that goes to every task.
LANGUAGES = 1000
BUCKETS = 1 << 15
WIDTH = 16
FOLDS, HELD_OUT = 4, 2
SEED = 3
UNKNOWN = "und"

# Letters keep their (lowered) byte, all other ASCII becomes a space.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of the block, and the text it belongs to (in order)."""
    letters = _FOLD[block.data]
    owner = block.owner()
    buckets, owners = [], []
    for n, factors in ((3, (31, 1009, 65599)), (4, (37, 2027, 40503, 104729))):
        size = len(letters) - n + 1
        if size <= 0:
            continue
        mixed = np.full(size, n, np.uint32)
        blank = np.ones(size, bool)
        for i, factor in enumerate(factors):
            part = letters[i : i + size]
            mixed += part * np.uint32(factor)
            blank &= part == 32
        mixed *= np.uint32(2654435761)
        inside = ~blank & (owner[:size] == owner[n - 1 :])
        buckets.append((mixed[inside] >> np.uint32(17)).astype(np.int64))
        owners.append(owner[:size][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    floor: float

    def probabilities(self, block: Block) -> np.ndarray:
        bucket, owner = grams(block)
        total = np.maximum(np.bincount(owner, minlength=len(block)), 1)
        logits = np.stack(
            [np.bincount(owner, weights=self.table[:, k][bucket], minlength=len(block)) / total for k in range(len(self.languages))], axis=1
        )
        return softmax((logits + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], steps: int = 300, rate: float = 300.0) -> Model:
    """Trains on ``(buckets, counts)`` per text, at least ``steps`` batches of 64; every fifth text calibrates."""
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def average(chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(chosen), BUCKETS), np.float32)
        for i, t in enumerate(chosen):
            buckets, counts = texts[t]
            x[i, buckets] = counts / max(1, counts.sum())
        return x

    held = np.arange(len(texts)) % 5 == 4
    if len(texts) < 20:
        held[:] = False
    held[np.unique(labels, return_index=True)[1]] = False  # a text of every language is learned
    learn, check = np.flatnonzero(~held), np.flatnonzero(held)
    epochs = max(4, -(-steps * 64 // max(1, len(learn))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            x = average(chosen)
            hidden = x @ embedding
            wrong = softmax(hidden @ weights + bias)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1
            wrong /= len(chosen)
            back = wrong @ weights.T
            weights -= 0.05 * step * (hidden.T @ wrong)
            bias -= 0.05 * step * wrong.sum(0)
            used = np.flatnonzero(x.any(axis=0))
            embedding[used] -= step * (x[:, used].T @ back)

    table = embedding @ weights
    temperature, floor = 1.0, 0.0
    if len(check):
        logits = np.concatenate([average(check[i : i + 64]) @ table for i in range(0, len(check), 64)]) + bias
        right = labels[check]

        def loss(t: float) -> float:
            return -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), right], 1e-12)).mean()

        temperature = float(min(np.geomspace(0.25, 10, 41), key=loss))
        best = softmax(logits / temperature)
        # One in a hundred of the right answers scores less.
        hits = best.max(1)[best.argmax(1) == right]
        floor = min(0.95, float(np.quantile(hits, 0.01))) if len(hits) else 0.0
    return Model(languages, table, bias, temperature, floor)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from rows with text and language outside the held-out fold (crc32 of the key mod 4 is not 2).

    Of each language the ``sample`` / languages rows (``EACH`` at least) with the smallest seeded hashes of key and
    text are used, whole texts, so every language is learned and reruns agree; rows equal in both count
    once, and rows with a null key, text or language are not used. More than ``LANGUAGES`` languages
    are a ``ValueError``: such a column holds something else. None if no row qualifies.
    """
    key_of, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(
        key_of.alias("__id"), body.alias("__t"), F.col(f"`{lang}`").alias("__y"), F.xxhash64(F.lit(SEED), key_of.cast("string"), body).alias("__h")
    ).where((remainder(F.col("__id"), FOLDS) != HELD_OUT) & F.col("__t").isNotNull() & F.col("__y").isNotNull())
    number = rows.select("__y").distinct().limit(LANGUAGES + 1).count()
    if number > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang}")
    if not number:
        return None
    each = max(EACH, sample // number)
    # The hash at which each language's sample ends. Counts of hashes by their leading bits tell which
    # of them can be in it, so few are sorted, whatever the language's share of the rows.
    hashes = stored(rows.select("__y", "__h", F.shiftright("__h", 52).alias("__b")).distinct(), "language-hashes")
    before = F.coalesce(F.sum("count").over(W.partitionBy("__y").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = hashes.groupBy("__y", "__b").count().withColumn("__before", before).where(F.col("__before") < each)
    low = hashes.join(cells.select("__y", "__b"), ["__y", "__b"])
    smallest = low.withColumn("__n", F.row_number().over(W.partitionBy("__y").orderBy("__h"))).where(F.col("__n") <= each)
    ends = smallest.groupBy("__y").agg(F.max("__h").alias("__end")).collect()
    ends = docs.sparkSession.createDataFrame([tuple(r) for r in ends], "__y string, __end bigint")
    rows = rows.withColumn("__y", F.col("__y").cast("string")).join(F.broadcast(ends), "__y").where(F.col("__h") <= F.col("__end"))
    rows = rows.dropDuplicates(["__y", "__h"]).select("__id", "__t", "__y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for block in blocks(batch["__t"]):
                bucket, owner = grams(block)
                place, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
                cuts = np.searchsorted(place, np.arange(len(block) + 1) * BUCKETS)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    held = np.minimum(n[a:b], 60_000).astype(np.float16)
                    found.append(((place[a:b] % BUCKETS).astype(np.uint16).tobytes(), held.tobytes()))
            yield pd.DataFrame(
                {"id": batch["__id"].astype(str), "lang": batch["__y"], "b": [x for x, _ in found], "n": [x for _, x in found]}
            )

    got = rows.mapInPandas(run, "id string, lang string, b binary, n binary").collect()
    got = sorted((r["id"], r["lang"], bytes(r["b"]), bytes(r["n"])) for r in got)
    languages = sorted({r[1] for r in got})
    at = {name: i for i, name in enumerate(languages)}
    # Seeded, so that every fifth text is spread over the languages.
    got = [got[i] for i in np.random.default_rng(SEED).permutation(len(got))]
    texts = [(np.frombuffer(b, np.uint16), np.frombuffer(n, np.float16).astype(np.float32)) for _, _, b, n in got]
    return fit(texts, np.array([at[r[1]] for r in got]), languages)


def classified(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out, lang_pred, score, confident``.

    ``lang_pred`` is the language with the highest calibrated probability, ``score`` that
    probability, and ``confident`` says that it reaches the model's calibrated floor. Null texts,
    texts without a letter and all texts where nothing was learned are ``und`` with score 0.
    ``held_out`` marks the fold that ``train`` leaves out (false for a null key). An empty table
    gives no rows; other columns are ignored.
    """

    @F.pandas_udf("lang string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [model.probabilities(block) for block in blocks(texts)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
            names = np.array(model.languages, dtype=object)
            yield pd.DataFrame({"lang": names[p.argmax(axis=1)] if len(p) else [], "score": p.max(axis=1) if len(p) else []})

    body = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{key}`"),
        F.coalesce(remainder(F.col(f"`{key}`"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
        (best(body) if model else F.lit(None).cast("struct<lang:string,score:double>")).alias("__best"),
    )
    known = F.col("__letters") & F.col("__best").isNotNull()
    return rows.select(
        F.col(f"`{key}`"), "held_out",
        F.when(known, F.col("__best.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("__best.score")).otherwise(0.0).alias("score"),
        (known & (F.col("__best.score") >= (model.floor if model else 0.0))).alias("confident"),
    )
