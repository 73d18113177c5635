"""Byte-level BPE encoding and decoding: batched numpy merge rounds.

Texts are cut into words by the tokenizer's pattern. The symbols of all new words of a batch lie in
one flat array. In each round the pairs of neighbours are looked up by binary search over the
sorted pair keys, every word merges its pair of lowest rank wherever it stands (from the left, not
overlapping), and words without a known pair leave the array. A merged symbol takes part only in
pairs of higher rank, so a round for each rank of a word gives what merging one pair at a time
does. Words seen before come from a table of bounded size.

Decoding gathers the bytes of all ids of a batch from one flat table.

The model is read on the driver from a tokenizer's JSON file, a few megabytes of arrays whatever the
input; tasks get it with their function.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text looked at together, and of a piece of a long text.
BLOCK_BYTES = 1 << 20
# Words, and ids of words, that a task keeps.
KEPT_WORDS, KEPT_IDS = 1 << 18, 1 << 22
_NONE = np.int32(2**31 - 1)

# Letters and numbers that Unicode has got after the version the tokenizers library
# knows; there they are neither.
NEWER = "".join(
    "-".join(chr(int(c, 16)) for c in part.split("-"))
    for part in """
        0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
        10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
        16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24
        1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
        2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
    """.split()
)


def _pattern(letter: str, number: str, other: str) -> str:
    """The byte-level word pattern for given classes of characters."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


# The same words three times: texts of ASCII only, most texts, and texts with newer characters.
_PLAIN = re.compile(_pattern("[A-Za-z]", "[0-9]", r"[^\sA-Za-z0-9]"), re.ASCII)
_USUAL = regex.compile(_pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
_RARE = regex.compile(
    _pattern(rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]"), regex.VERSION1
)
_NEWER = re.compile(f"[{NEWER}]")
# Places where a word ends whatever follows.
_CUT = regex.compile(r"(?<=[A-Za-z])(?![A-Za-z])(?=[\x00-\x7f])|(?<=[0-9])(?![0-9])(?=[\x00-\x7f])|(?<=\S)(?=\s)")


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens; together they are the text."""
    if text.isascii():
        return _PLAIN.findall(text)
    return (_RARE if max(text) >= NEWER[0] and _NEWER.search(text) else _USUAL).findall(text)


def pieces(text: str, limit: int = BLOCK_BYTES) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters, cut where a word ends in any case."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, the others from 256 on in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the flat array that hold the slices ``starts, sizes`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


@dataclass(frozen=True)
class Model:
    """``keys`` are the sorted pairs (left id, right id in the low half), with rank and merged id of each."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    bytes_to_id: np.ndarray
    special: dict[str, int]
    table: np.ndarray  # bytes of all ids, id ``i`` at table_starts[i], table_sizes[i] long
    table_starts: np.ndarray
    table_sizes: np.ndarray

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pair = np.full(len(symbols), _NONE, np.int32)  # rank of each symbol with the next of its word
        stale = np.arange(len(symbols))
        done, owners = [], []
        while len(symbols):
            stale = stale[stale < len(symbols) - 1]
            key = (symbols[stale].astype(np.int64) << 32) | symbols[stale + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (owner[stale] == owner[stale + 1])
            pair[stale] = np.where(found, self.ranks[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(pair, first), lengths)
            stay = lowest != _NONE
            if not stay.all():
                done.append(symbols[~stay])
                owners.append(owner[~stay])
            spot = np.flatnonzero((pair == lowest) & stay)
            # In a chain of overlapping places (a a a) every second one merges.
            chain = np.concatenate(([True], np.diff(spot) != 1)) if len(spot) else np.zeros(0, bool)
            order = np.arange(len(spot))
            spot = spot[(order - np.maximum.accumulate(np.where(chain, order, 0))) % 2 == 0]
            symbols[spot] = self.merged[pair[spot]]
            pair[spot + 1] = _NONE
            stay[spot + 1] = False
            place = np.cumsum(stay) - 1
            # A merged symbol changes its own pair and that of the symbol before it.
            pair[spot] = _NONE
            stale = place[spot]
            stale = np.concatenate((stale, stale[stale > 0] - 1))
            symbols, owner, pair = symbols[stay], owner[stay], pair[stay]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner = np.concatenate(owners)
        # Each word left the array whole, so a stable sort brings the words back in order.
        return np.concatenate(done)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; ids that the model does not have stand for nothing."""
        known = ids[(ids >= 0) & (ids < len(self.table_sizes))]
        return self.table[gathered(self.table_starts[known], self.table_sizes[known])].tobytes()


def load(path: str) -> Model:
    """A byte-level BPE model from a tokenizer's JSON file.

    Files that ask for anything else (a normaliser, a leading space, dropout, special tokens that
    strip blanks) end in a ``ValueError``.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    unlike = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    if model["type"] != "BPE" or unlike or model.get("byte_fallback") or model.get("ignore_merges") or odd:
        raise ValueError(f"not a plain BPE model: {model['type']} {unlike} {odd}")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("not a byte-level tokenizer without normaliser and leading space")
    vocabulary = model["vocab"]
    symbols = byte_symbols()
    byte_of = {s: b for b, s in enumerate(symbols)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    key = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], np.int64)
    ranks = np.argsort(key, kind="stable")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spelled = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items()}
    spelled |= {i: s.encode() for s, i in special.items()}
    texts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return Model(
        keys=key[ranks],
        ranks=ranks.astype(np.int32),
        merged=np.array([vocabulary[a + b] for a, b in merges], np.int32),
        bytes_to_id=np.array([vocabulary[s] for s in symbols], np.int32),
        special=special,
        table=np.frombuffer(b"".join(texts), np.uint8),
        table_starts=np.cumsum(sizes) - sizes,
        table_sizes=sizes,
    )


class Encoder:
    """Encodes texts batch by batch; keeps the ids of words it has seen, up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for text, number in self.model.special.items():
            self._add([text], np.array([number], np.int32), np.ones(1, np.int64))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def words(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens of a text, piece by piece."""
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                yield [part]
            else:
                yield from map(words_of, pieces(part))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after another, and the number of ids of each."""
        if len(self.index) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self.forget()
        new = list(set(words).difference(self.index))
        if new:
            self._add(new, *self.model.encode([w.encode("utf-8", "surrogatepass") for w in new]))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        return self.ids[gathered(self.starts[at], sizes)], sizes

    def texts(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin and end in it."""
        held, ends = [], [np.zeros(1, np.int64)]
        words: list[str] = []
        marks: list[int] = []  # texts end behind so many of the words

        def flush(total: int) -> int:
            ids, sizes = self.encode(words)
            reached = np.concatenate(([0], np.cumsum(sizes)))
            held.append(ids)
            ends.append(total + reached[np.array(marks, np.int64)])
            words.clear()
            marks.clear()
            return total + len(ids)

        total = 0
        for text in texts:
            for some in self.words(text):
                words += some
                if len(words) > KEPT_WORDS:
                    total = flush(total)
            marks.append(len(words))
        flush(total)
        return np.concatenate(held), np.concatenate(ends)


def _groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``limit`` bytes, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, end
        at = end


def encoded(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key and ``ids`` (array of int) of the whole text.

    A special token's string in a text becomes its id, as the tokenizers library has it. Null and
    empty texts have no ids. Null and repeated keys are kept as they are, an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in _groups(np.array([len(t.as_buffer()) for t in texts]), BLOCK_BYTES):
                ids, ends = encoder.texts(t.as_py().decode("utf-8", "replace") for t in texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["__key", "ids"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, ids array<int>").withColumnRenamed("__key", key)


def decoded(rows: DataFrame, model: Model, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: key, ``ids`` and ``decoded``, the text of the ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD, ids that the model does not have nothing, null arrays the
    empty text. Null and repeated keys are kept, an empty table gives no rows.
    """
    none = F.array().cast("array<int>")
    held = rows.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{ids}`"), none).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for a, b in _groups(4 * sizes, BLOCK_BYTES):
                texts = [
                    model.decode(np.asarray(x.values.fill_null(-1))).decode("utf-8", "replace") if len(x) else ""
                    for x in (lists[i] for i in range(a, b))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], lists[a:b], pa.array(texts, pa.string())], names=["__key", "ids", "decoded"]
                )

    kind = held.schema["__key"].dataType.simpleString()
    return held.mapInArrow(run, f"__key {kind}, ids array<int>, decoded string").withColumnRenamed("__key", key)


def ids_digest(ids: Iterable[int]) -> str:
    """sha256 of the decimal ids joined by commas, in steps of bounded size."""
    digest = hashlib.sha256()
    for at in range(0, len(ids), 1 << 16):
        digest.update((b"," if at else b"") + ",".join(map(str, ids[at : at + (1 << 16)].tolist())).encode())
    return digest.hexdigest()


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of :func:`decoded`: key, ``n_tokens`` and digests of ids and decoded text."""

    @F.arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        return pa.array([ids_digest(np.asarray(x.values)) if len(x) else ids_digest(np.zeros(0, int)) for x in lists], pa.string())

    return rows.select(
        F.col(f"`{key}`"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
