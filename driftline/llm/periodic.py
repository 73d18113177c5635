"""Periodic run detection: block convolution at dyadic scales.

A run is a longest stretch of words with smallest period q and at least ``EXPONENT`` periods. At
scale L, for periods from L to 2L - 1, the text is cut into blocks of L words. A run of such a
period holds two neighbouring blocks, whole and together with their copies one period later. So
each block is compared with all places of the window behind it at once: the sum of squared
differences of word codes is a convolution, done exactly by a number-theoretic transform modulo a
prime. Zero sums seed runs, which are checked word by word and extended to both sides.

Three exact rules keep work near the words that do repeat. Each word of a block of a run comes
again within 2L words; neighbours match at the same distance; and a block that lies, with its
window, in a run of a shorter period matches at multiples of that period only, so it is skipped.

Texts are taken in flat arrays of about a megabyte (one longer text has its own), with a word that
occurs nowhere else between two texts. Nothing is cut off: the work grows with n log^2 n at worst.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import WORD, remainder

# A run has at least so many periods, and so many words.
EXPONENT, LEAST_WORDS = 4, 6
# Bytes of text looked at together, and of a piece of a long text.
BLOCK_BYTES = 1 << 20
# Numbers in one array of a transform.
ARRAY = 1 << 21

# 15 * 2^27 + 1, and a generator: transforms of up to 2^27 numbers.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_FAR = np.int32(2**31 - 1)


# --- the transform ----------------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, in place."""
    x -= (x // _P) * _P
    return x


def _less(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime where it is below twice the prime: a negative number wraps round to a large one."""
    return np.minimum(x, x - _P)


def roots(size: int, inverse: bool = False) -> np.ndarray:
    """The first half of the powers of a ``size``-th root of one."""
    step = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        step = pow(step, PRIME - 2, PRIME)
    out = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = _reduced(out[:more] * np.uint64(pow(step, done, PRIME)))
        done += more
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of every row (a power of two long); the result is in bit-reversed order."""
    rows, size = x.shape
    powers, half = roots(size), size // 2
    while half:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        turned = _reduced((a + (_P - b)) * powers[:: size // (2 * half)])
        x = np.stack((_less(a + b), turned), axis=2)
        half //= 2
    return x.reshape(rows, size)


def backward(x: np.ndarray) -> np.ndarray:
    """Undoes :func:`forward`."""
    rows, size = x.shape
    powers, half = roots(size, inverse=True), 1
    while half < size:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], _reduced(x[:, :, 1] * powers[:: size // (2 * half)])
        x = np.stack((_less(a + b), _less(a + (_P - b))), axis=2)
        half *= 2
    return _reduced(x.reshape(rows, size) * np.uint64(pow(size, PRIME - 2, PRIME)))


def matches(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (block, distance): the block at ``starts`` comes again ``length`` to ``2 length - 1`` words later.

    ``codes`` reaches ``3 length`` words beyond each start. A copy is never missed; a sum that is
    zero by chance, modulo the prime, is left for the caller to check.
    """
    size, found = 2 * length, []
    for at in range(0, len(starts), max(1, ARRAY // size)):
        some = starts[at : at + max(1, ARRAY // size)]
        seen = codes[some[:, None] + np.arange(3 * length - 1)]
        block = np.zeros((len(some), size), np.uint64)
        block[:, :length] = seen[:, length - 1 :: -1] if length > 1 else seen[:, :1]
        window = np.zeros((len(some), size), np.uint64)
        window[:, : size - 1] = seen[:, length:]
        product = backward(_reduced(forward(block) * forward(window)))[:, length - 1 : size - 1]
        squares = _reduced(seen * seen)
        sums = np.concatenate((np.zeros((len(some), 1), np.uint64), np.cumsum(squares, axis=1)), axis=1)
        own = sums[:, length : length + 1]
        there = sums[:, 2 * length :] - sums[:, length : 2 * length]
        row, offset = np.nonzero(_reduced(own + there) == _less(product + product))
        found.append((at + row, offset + length))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --- runs -------------------------------------------------------------------------------------


def _reach(words: np.ndarray) -> np.ndarray:
    """For each place the distance to the next same word."""
    order = np.argsort(words, kind="stable").astype(np.int32)
    out = np.full(len(words), _FAR, np.int32)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _edge(same: np.ndarray) -> int:
    """Leading trues."""
    return len(same) if same.all() else int(same.argmin())


def _extended(words: np.ndarray, lo: int, hi: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``[lo, hi)`` in which each word equals the one ``d`` later."""
    step = 64
    while lo > 0:
        a = max(0, lo - step)
        grown = _edge((words[a:lo] == words[a + d : lo + d])[::-1])
        lo -= grown
        if lo > a:
            break
        step *= 2
    step = 64
    while hi + d < len(words):
        b = min(len(words) - d, hi + step)
        grown = _edge(words[hi:b] == words[hi + d : b + d])
        hi += grown
        if hi < b:
            break
        step *= 2
    return lo, hi


def _stretches(words: np.ndarray, lo: int, hi: int, d: int) -> Iterator[tuple[int, int]]:
    """Longest stretches that touch ``[lo, hi)`` and equal what is ``d`` later."""
    same = words[lo:hi] == words[lo + d : hi + d]
    if same.all():
        yield _extended(words, lo, hi, d)
        return
    turns = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        yield _extended(words, lo + a, lo + b, d)


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """Sorted ``(start, length, period)`` of all runs in an array of word numbers (not negative).

    ``longest`` is the size of the longest text where the array holds several, each pair of them
    parted by a number that occurs once.
    """
    n = len(words)
    longest = n if longest is None else longest
    if longest < LEAST_WORDS:
        return []
    far = _reach(words)
    codes = np.random.default_rng(5).integers(1, PRIME, int(words.max()) + 2, dtype=np.uint64)
    # Behind the last word stands the code of no word.
    codes = np.concatenate((codes[words], np.full(3 * (longest // EXPONENT), codes[-1])))
    known: dict[tuple[int, int], int] = {}
    length = 1
    while EXPONENT * length <= longest:
        if length > 1:
            if len(far) % 2:
                far = np.append(far, _FAR)
            far = np.maximum(far[::2], far[1::2])
        near = far < 2 * length
        first, last = [], []
        for start, end in known:
            a, b = -(-start // length), (end - 3 * length) // length
            if a <= b:
                first.append(a)
                last.append(b + 1)
        if first:
            inside = np.zeros(len(near) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, last, -1)
            near &= np.cumsum(inside[:-1]) == 0
        beside = np.zeros(len(near), bool)
        beside[1:] |= near[:-1]
        beside[:-1] |= near[1:]
        picked = np.flatnonzero(near & beside)
        if len(picked):
            for start, end, period in _at_scale(words, codes, picked, length):
                known.setdefault((start, end), period)
        length *= 2
    return sorted((s, e - s, q) for (s, e), q in known.items() if e - s >= LEAST_WORDS)


def _at_scale(words: np.ndarray, codes: np.ndarray, picked: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Runs with periods from ``length`` to ``2 length - 1`` that hold some of the picked blocks: start, end, period."""
    n = len(words)
    block, distance = matches(codes, picked * length, length)
    block = picked[block]
    if not len(block):
        return
    # Neighbouring blocks that match at the same distance; a run has two or more.
    wide = np.int64(picked[-1] + 2)
    key = np.sort(distance * wide + block)
    cuts = np.flatnonzero(np.diff(key) != 1) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)])), strict=True):
        if b - a < 2:
            continue
        d, block_of = int(key[a] // wide), int(key[a] % wide)
        lo = block_of * length
        hi = min(lo + int(b - a) * length, n - d)
        for start, end in _stretches(words, lo, hi, d) if lo < hi else ():
            if end + d - start >= EXPONENT * d:
                yield start, end + d, d


# --- texts ------------------------------------------------------------------------------------


def pieces(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes, cut at blanks."""
    at = 0
    while len(text) - at > limit:
        blank = _BLANK.search(text, at + limit)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


@dataclass
class Batch:
    """Texts as one array of word numbers, each text followed by a number of its own."""

    numbers: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    words: list[bytes]

    @staticmethod
    def of(texts: Iterable[bytes]) -> Batch:
        index: dict[bytes, int] = {}
        held, sizes = [], []
        for i, text in enumerate(texts):
            size = 0
            for piece in pieces(text):
                split = piece.split()
                held.append(np.fromiter((index.setdefault(w, len(index)) for w in split), np.int32, len(split)))
                size += len(split)
            held.append(np.array([-1 - i], np.int32))
            sizes.append(size)
        numbers = np.concatenate(held) if held else np.zeros(0, np.int32)
        gap = numbers < 0
        numbers[gap] = len(index) - 1 - numbers[gap]
        sizes = np.array(sizes, np.int64)
        return Batch(numbers, np.cumsum(sizes + 1) - sizes - 1, sizes, list(index))

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """Runs of each text, with places from the text's first word."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.sizes]
        found = find_runs(self.numbers, int(self.sizes.max(initial=0)))
        owner = np.searchsorted(self.starts, [f[0] for f in found], side="right") - 1
        for (start, length, period), i in zip(found, owner.tolist(), strict=True):
            out[i].append((start - int(self.starts[i]), length, period))
        return out

    def collapsed(self, i: int, runs: list[tuple[int, int, int]]) -> bytes:
        """A text's words joined by single spaces, without what runs repeat after their first period."""
        a, size = int(self.starts[i]), int(self.sizes[i])
        numbers = self.numbers[a : a + size]
        if runs:
            edges = np.zeros(size + 1, np.int64)
            for start, length, period in runs:
                edges[start + period] += 1
                edges[start + length] -= 1
            numbers = numbers[np.cumsum(edges[:-1]) == 0]
        words = self.words
        return b" ".join(words[k] for k in numbers.tolist())


def runs(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``runs`` (array of start, length, period by start, then
    period; words from 0) and ``collapsed``, the words without what runs repeat, joined by single spaces.

    Words lie between ASCII blanks, whole texts are read. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Null and repeated keys are kept as they are, an empty table gives
    no rows; other columns are ignored.
    """
    body = F.col(f"`{text}`") if isinstance(text, str) else text
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(body, F.lit("")).cast("binary").alias("__text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum([len(t.as_buffer()) for t in texts])
            at = 0
            while at < len(texts):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
                held = Batch.of(t.as_py() for t in texts[at:end])
                found = held.runs()
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                fields = [pa.array(flat[:, i]) for i in range(3)]
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at:end],
                        pa.array(held.sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(run))),
                        pa.array([held.collapsed(i, own) for i, own in enumerate(found)], pa.binary()),
                    ],
                    names=["__key", "n_words", "runs", "collapsed"],
                )
                at = end

    kind = rows.schema["__key"].dataType.simpleString()
    schema = f"__key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    out = rows.mapInArrow(detect, schema)
    return out.select(F.col("__key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The text, made periodic from a word on in about one text of ten, as the crc32 of the key says.

    With h that number and g = floor(h / 10), texts with h % 10 = 0 and n > 0 words get, for each word
    i >= a = g % n, word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). A null key or text
    changes nothing.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    body = F.col(f"`{text}`")
    g = F.floor(h / F.lit(10)).cast("bigint")

    def place(i: Column, at: Column) -> Column:
        a, p = at["a"], at["p"]
        return F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def cut(words: Column) -> Column:
        a = F.pmod(g, F.size(words).cast("bigint"))
        parts = F.floor((F.size(words) - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        return F.struct(a.alias("a"), (parts + 1).alias("p"))

    def rebuilt(words: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(words) - 1)
        return bound(cut(words), lambda at: F.array_join(F.transform(numbers, lambda i: F.get(words, place(i, at))), " "))

    chosen = F.coalesce(remainder(F.col(f"`{key}`"), 10) == 0, F.lit(False)) & F.coalesce(body.rlike(WORD), F.lit(False))
    return F.when(chosen, bound(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), rebuilt)).otherwise(body)


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of :func:`runs`: number of runs, the one with most periods, and digests of runs and collapsed text."""
    first = F.get("runs", F.lit(0))
    # Lengths over periods compared as products; of equal ones the earlier run stays.
    best = F.aggregate("runs", first, lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = found.withColumn("__best", best)
    return rows.select(
        F.col(f"`{key}`"),
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"__best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
