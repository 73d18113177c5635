"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (``base_spans``) give exact spans of four kinds. The field adds spans that are written
differently (telephone numbers without a plus sign, card numbers with other separators, addresses
in brackets). It is trained on a small labelled table whose digits and letters are varied by a
seed, sees only the shapes of a word and its neighbours, and is decoded by Viterbi over lines in
numpy batches. What it finds has to pass the kind's own check and must not overlap a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textbatch import Block, blocks, word_hashes

KINDS = ("email", "ip", "card", "phone")
# O, then first and following words of each kind.
TAGS = 1 + 2 * len(KINDS)

# Leftmost matches: a run that fails from its first character fails from every later one, so
# these start at the first only, and no input takes more than a few passes.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    parts = re.split(r"[^0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(text: str, least: int = 10) -> bool:
    return least <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the patterns, by start and kind."""
    spans, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            spans.append((start, 0, m.end()))
            done = m.end()
    for kind, pattern, passes in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if passes(m.group())]
    return sorted(spans)


# ---- word shapes ----------------------------------------------------------------------------

_CLASS = np.arange(256)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = 128
_CLASS = _CLASS.astype(np.uint8)
_HASHED = 1 << 12
# Feature tables: shape without lengths, shape with runs up to four, digits, length, ends; and the
# shape of the word before and after.
_SIZES = (_HASHED, _HASHED, 24, 24, 1 << 10, _HASHED + 1, _HASHED + 1)
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))
_OWN = 5


def _shape(data: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = np.concatenate(([0], np.cumsum(keep)))
    return (word_hashes(data[keep], at[starts], at[ends]) >> np.uint64(40)).astype(np.int64) % _HASHED


def shapes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Own features of each word: one column per table."""
    data = _CLASS[block.data]
    index = np.arange(len(data))
    change = np.concatenate(([True], data[1:] != data[:-1]))
    change[starts] = True
    run = index - np.maximum.accumulate(np.where(change, index, 0))
    digits = np.concatenate(([0], np.cumsum(data == ord("0"))))
    wide = data == 128
    letters = np.concatenate(([0], np.cumsum(~(wide & ~change))))
    return np.stack(
        [
            _shape(data, change, starts, ends),
            _shape(data, run < 4, starts, ends),
            np.minimum(digits[ends] - digits[starts], 23),
            np.minimum(letters[ends] - letters[starts], 23),
            (data[starts].astype(np.int64) * 31 + data[ends - 1]) % (1 << 10),
        ],
        axis=1,
    )


# ---- labelled table --------------------------------------------------------------------------

# A labelled text marks its spans as [kind text]. Digits and letters inside and outside are varied.
LABELLED = """
Write to [email anna.k@mail.example.com] for the full report.
Contact: [email j_doe99@example.org], or come by.
Mail <[email info@firma-x.example.de]> with questions.
the old address ([email b.lee+news@corp.example.net]) is closed
and the thin [email nmftmlee.22@mail7.example.com] of the
Server [ip 192.168.10.4] did not answer.
connect from [ip 10.0.0.255], then again
Blocked: [ip 172.16.254.1].
was seen at [ip 8.8.4.4] last night
Paid with [card 4539 1488 0343 6467] on Monday.
card number [card 4532015112830366] was charged
[card 5425-2334-3010-9903] expires soon, they said.
Use [card 4929.1234.5678.9015] for tests
on the [card 6011000990139424] and the
Call [phone +1 (269) 555-3296] before noon.
phone: [phone (415) 555-0132], ask for the clerk
My number is [phone 415-555-0199] now.
Tel. [phone 030 123 45678] or fax
ring [phone +49 30 9876543] im Büro
or [phone 555.867.5309] after work
Rufen Sie [phone 0171-2345678] an.
Appelez le [phone 01 23 45 67 89] demain.
Llame al [phone +34 912 345 678] hoy.
The meeting on 2021-03-14 starts at 10:30 sharp.
In 1999 there were 12 of them, then 3,500.
Licensed under the License, Version 2.0.
version 1.2.3 and 10.4 are out, see 3.1.4 too
the price rose from 12.50 to 1,299.00 dollars
Order 88213 shipped; parcel 4471 did not.
token = "2aeb8253858bf047bc9bb976166a40ef87db38b0" was found
hash 9f86d081884c7d65 and key AKIA1234ABCD
see chapter 12, pages 100-120, and note 7
On 12/05/2020 we paid 45 % more.
room 101 | room 102 | room 103 | end
THE, OF!! AND!! IN!! 4.0 TO!! HE!!
the### of%%% and&&& in*** 7 to$$$
Ein Haus, die Straße und der Fluß. Über alles.
Été, où la forêt dort; déjà vu.
El niño y la señora van a casa.
the of and to in is that it was for on are as with his they
Thing. Another thing, and then. Which was fine.
A b c d e f g. Of the, in that: no; yes!
score 3-2, then 10-0, at 5 to 4
follow @someone and #topic now
ISBN 978-3-16-148410-0 is a book
1. first 2. second 3. third
"""
VARIANTS = 8


def labelled_table(variants: int = VARIANTS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their spans ``(start, kind number, end)``."""
    rng = np.random.default_rng(17)
    rows = []
    for line in LABELLED.strip().split("\n"):
        for _ in range(variants):
            text, spans = "", []
            for part in re.split(r"(\[[a-z]+ [^\]]*\])", line):
                m = re.fullmatch(r"\[([a-z]+) (.*)\]", part)
                body = m.group(2) if m else part
                body = re.sub("[0-9]", lambda _: str(rng.integers(10)), body)
                body = re.sub("[a-z]", lambda _: chr(97 + rng.integers(26)), body)
                if m:
                    spans.append((len(text), KINDS.index(m.group(1)), len(text) + len(body)))
                elif rng.random() < 0.5:
                    # Longer and shorter words.
                    body = re.sub(r"(?<![A-Za-z])[a-z]{2,}", lambda w: w.group() * int(rng.integers(1, 4)), body)
                text += body
            rows.append((text, spans))
    return rows


# ---- the field -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # feature x tag
    moves: np.ndarray  # tag before x tag
    begin: np.ndarray


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Zero where a tag may follow another (or begin), -inf where not: a following tag needs its own kind before it."""
    moves, begin = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        moves[:, inside] = -np.inf
        moves[[inside - 1, inside], inside] = 0
        begin[inside] = -np.inf
    return moves, begin


def emissions(field_weights: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Score of every tag for every word; ``first`` marks the first word of a line."""
    code = own @ np.array([1 << 45, 1 << 33, 1 << 28, 1 << 23, 1], np.int64) if len(own) else np.zeros(0, np.int64)
    _, at, of = np.unique(code, return_index=True, return_inverse=True)
    kinds = own[at]
    here = sum(field_weights[_OFFSETS[k] + kinds[:, k]] for k in range(_OWN)) if len(at) else np.zeros((0, TAGS))
    before, after = (field_weights[_OFFSETS[k] + kinds[:, 0]] for k in (_OWN, _OWN + 1))
    score = here[of]
    edge_before, edge_after = (field_weights[_OFFSETS[k] + _HASHED] for k in (_OWN, _OWN + 1))
    last = np.concatenate((first[1:], [True])) if len(first) else first
    score = score + np.where(first[:, None], edge_before, before[np.concatenate(([0], of[:-1]))] if len(of) else before)
    return score + np.where(last[:, None], edge_after, after[np.concatenate((of[1:], [0]))] if len(of) else after)


def _context(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All feature rows of each word, neighbours included."""
    last = np.concatenate((first[1:], [True]))
    before = np.where(first, _HASHED, np.concatenate(([0], own[:-1, 0])))
    after = np.where(last, _HASHED, np.concatenate((own[1:, 0], [0])))
    return np.column_stack((own, before, after)) + _OFFSETS[:-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximises the conditional likelihood of the table's tags by Adam (forward and backward sums over padded lines)."""
    block = Block([t.encode() for t, _ in table])
    starts, ends = block.words()
    owner = block.owner()[starts]
    own = shapes(block, starts, ends)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    rows = _context(own, first)
    gold = np.zeros(len(starts), np.int64)
    for i, (text, spans) in enumerate(table):
        for a, kind, b in spans:
            a, b = (block.starts[i] + len(text[:x].encode()) for x in (a, b))
            words = np.flatnonzero((starts < b) & (ends > a))
            gold[words] = 2 + 2 * kind
            gold[words[0]] = 1 + 2 * kind
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
    n, longest = len(table), int(place.max()) + 1
    length = np.bincount(owner, minlength=n)
    fixed_moves, fixed_begin = _allowed()

    weights, moves, begin = np.zeros((_OFFSETS[-1], TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    params = [weights, moves, begin]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold_moves = np.zeros((TAGS, TAGS))
    np.add.at(gold_moves, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    gold_begin = np.bincount(gold[first], minlength=TAGS)
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, TAGS))
        e[owner, place] = weights[rows].sum(axis=1)
        t, b = moves + fixed_moves, begin + fixed_begin
        forward, backward = np.full((n, longest, TAGS), -1e30), np.zeros((n, longest, TAGS))
        forward[:, 0] = b + e[:, 0]
        for i in range(1, longest):
            forward[:, i] = _logsum(forward[:, i - 1, :, None] + t, 1) + e[:, i]
        for i in range(longest - 2, -1, -1):
            inner = _logsum(t + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where((i + 1 < length)[:, None], inner, 0)
        total = _logsum(forward[np.arange(n), length - 1], 1)
        held = np.exp(forward[owner, place] + backward[owner, place] - total[owner, None])
        by_tag = held.copy()
        by_tag[np.arange(len(gold)), gold] -= 1
        grad = np.zeros_like(weights)
        for k in range(rows.shape[1]):
            np.add.at(grad, rows[:, k], by_tag)
        pair = np.zeros((TAGS, TAGS))
        for i in range(1, longest):
            live = i < length
            both = forward[live, i - 1, :, None] + t + (e[live, i] + backward[live, i])[:, None, :] - total[live, None, None]
            pair += np.exp(both).sum(axis=0)
        grads = [grad / n, (pair - gold_moves) / n, (held[first].sum(axis=0) - gold_begin) / n]
        for p, g, m, s in zip(params, grads, means, squares, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves + fixed_moves, begin + fixed_begin)


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(labelled_table())


# Words of a decoded window, and words of context on either side: a longer line is cut into windows
# and only their middles count.
WINDOW, MARGIN = 256, 24


def viterbi(score: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Best tags of sequences that stand one after another in ``score``."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    best = np.zeros(len(score), np.int8)
    if not len(lengths):
        return best
    back = np.zeros((len(score), TAGS), np.int8)
    state = field.begin + score[begin]
    finals = np.zeros((len(lengths), TAGS))
    finals[:] = state
    active = len(lengths)
    for i in range(1, int(sorted_lengths[0])):
        active = int(np.searchsorted(-sorted_lengths, -i, side="left"))
        paths = state[:active, :, None] + field.moves
        back[begin[:active] + i] = paths.argmax(axis=1)
        state = paths.max(axis=1) + score[begin[:active] + i]
        finals[:active] = state
    tag = finals.argmax(axis=1)
    for i in range(int(sorted_lengths[0]) - 1, -1, -1):
        active = int(np.searchsorted(-sorted_lengths, -i, side="left"))
        at = begin[:active] + i
        best[at] = tag[:active]
        tag[:active] = back[at, tag[:active]]
    return best


def tags_of(block: Block, starts: np.ndarray, ends: np.ndarray, field: Field) -> np.ndarray:
    """The tag of every word of the block; sequences are lines."""
    if not len(starts):
        return np.zeros(0, np.int8)
    newlines = np.concatenate(([0], np.cumsum(block.data == 10)))
    line = newlines[starts]
    first = np.concatenate(([True], line[1:] != line[:-1]))
    score = emissions(field.weights, shapes(block, starts, ends), first)
    tags = np.zeros(len(starts), np.int8)
    # A line in which no word gains from another tag than O, whatever moves it could use, is all O.
    reach = field.moves[np.isfinite(field.moves)].max() - field.moves[0, 0]
    ends_gain = max(0.0, (field.begin[np.isfinite(field.begin)] - field.begin[0]).max())
    gain = (score[:, 1:].max(axis=1) - score[:, 0]) + 2 * max(0.0, reach) + ends_gain
    number = np.cumsum(first) - 1
    live = np.bincount(number, weights=gain > 0) > 0
    line_starts = np.flatnonzero(first)
    line_sizes = np.diff(np.concatenate((line_starts, [len(starts)])))
    windows = []
    for a, size in zip(line_starts[live].tolist(), line_sizes[live].tolist(), strict=True):
        for at in range(0, size, WINDOW):
            low, high = max(0, at - MARGIN), min(size, at + WINDOW + MARGIN)
            windows.append((a + low, high - low, a + at, min(WINDOW, size - at)))
    if not windows:
        return tags
    w = np.array(windows)
    place = np.repeat(w[:, 0] - (np.cumsum(w[:, 1]) - w[:, 1]), w[:, 1]) + np.arange(w[:, 1].sum())
    found = viterbi(score[place], w[:, 1], field)
    middle = (place >= np.repeat(w[:, 2], w[:, 1])) & (place < np.repeat(w[:, 2] + w[:, 3], w[:, 1]))
    tags[place[middle]] = found[middle]
    return tags


_TRIM = {0: "[A-Za-z0-9].*[A-Za-z0-9]", 1: "[0-9].*[0-9]", 2: "[0-9].*[0-9]", 3: r"[+(]?[0-9].*[0-9]"}


def _checked(kind: int, text: str) -> bool:
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == 3:
        return _is_phone(text, 8) and re.search("[A-Za-z]", text) is None
    return (_is_ip if kind == 1 else _is_card)(text)


def field_spans(block: Block, field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans the field finds in each text, in code points, trimmed and checked."""
    starts, ends = block.words()
    tags = tags_of(block, starts, ends, field)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
    heads = np.flatnonzero(tags % 2 == 1)
    if not len(heads):
        return spans
    of = np.searchsorted(block.ends, starts[heads])
    for head, i in zip(heads.tolist(), of.tolist(), strict=True):
        tail = head
        while tail + 1 < len(tags) and tags[tail + 1] == tags[head] + 1:
            tail += 1
        kind = int(tags[head]) // 2
        a, b = int(starts[head]), int(ends[tail])
        words = block.data[a:b].tobytes().decode("utf-8", "replace")
        m = re.search(_TRIM[kind], words, re.S)
        if m and _checked(kind, m.group()):
            at = len(block.data[block.starts[i] : a].tobytes().decode("utf-8", "surrogatepass")) + m.start()
            spans[i].append((at, kind, at + len(m.group())))
    return spans


def all_spans(texts: pd.Series, field: Field) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, by start and kind."""
    at = 0
    values = list(texts)
    for block in blocks(values):
        owner = block.owner()
        sign = np.bincount(owner[(_CLASS[block.data] == ord("0")) | (block.data == ord("@"))], minlength=len(block)) > 0
        more = field_spans(block, field)
        for i in range(len(block)):
            text = values[at + i]
            # Every pattern has a digit or an at sign.
            base = base_spans(text) if sign[i] else []
            new = [s for s in more[i] if all(s[2] <= b[0] or s[0] >= b[2] for b in base)]
            yield base, sorted(base + new)
        at += len(block)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: key, ``n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the base spans, ``spans`` lists all spans as ``kind:start:end`` in code
    points, end exclusive. Null and empty texts have none (the digest of an empty list). Equal
    texts get equal answers. An empty table gives no rows; other columns are ignored.
    """
    model = field or trained()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, every in all_spans(texts, model):
                count = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(f"`{key}`"), find(F.col(f"`{text}`")).alias("__f")).select(F.col(f"`{key}`"), "__f.*")
