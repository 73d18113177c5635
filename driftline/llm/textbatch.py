"""Texts as numpy bytes: blocks of bounded size, words and grams without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Bytes of text looked at together; one text may be longer.
BLOCK_BYTES = 1 << 20

_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


class Block:
    """Some texts, each followed by a newline: ``data`` bytes, and text ``i`` at ``starts[i]:ends[i]``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text that each byte belongs to (its newline included)."""
        return np.repeat(np.arange(len(self)), self.ends - self.starts + 1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words between ASCII blanks."""
        blank = _BLANKS[self.data]
        edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks that together hold all texts in order; null counts as empty."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(data) > limit:
            yield Block(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield Block(held)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    place = at - np.repeat(starts, sizes)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))))
    return np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(sizes) - sizes)
