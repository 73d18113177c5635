"""Source divergence audit: one-hot level products.

How far the words of a language's sources lie apart is a sum over terms of a price that depends on
two counts only, the term's count in either source. So terms need not be priced one by one. Each
term is a row of an indicator matrix with a column for each (source, count level); the product of
that matrix and its transpose holds, for every two sources, the table of how many terms have count
a in one and b in the other. The products are taken over blocks of terms, in tiles whose columns are
the levels that occur there, and are exact: their entries are small whole numbers. Each cell of a
tile's joint tables is priced once, and only the sums for two sources leave a block.

Counts are sums of partial counts from batches of texts. A block is a hash range of a language's
terms whose size is bounded by counted cells, so a language with a third of all texts has many
blocks. All arithmetic on counts and prices is in whole numbers, wide ones in two halves or as decimal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import stored

# Documents of its language that a kept term is in, at least; terms listed per source.
LEAST_DOCUMENTS, LISTED = 3, 200
SCALE = 1_000_000_000
# Counts of terms (term, source) in a block, about; rows and columns of a tile of the indicator matrix.
# Few rows have few levels, so that the dense products stay small.
BLOCK_CELLS, TILE_ROWS, TILE_COLUMNS = 1 << 14, 256, 1024
# Prices are summed in two halves: above and below so many bits.
HALF = 30
# Bytes of a long text counted together; counts a task holds before it hands them on.
PIECE_BYTES, HELD_COUNTS = 1 << 20, 1 << 17

# Letters A-Z are lowered and bytes of other than ASCII characters kept; all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Folded text in pieces of about ``limit`` bytes, cut between terms."""
    at = 0
    while at < len(text):
        end = at + limit
        part = text[at:end].translate(_FOLD)
        while end < len(text) and not part.endswith(b" "):
            # The term at the end goes on: take more, up to the next place between terms.
            more = text[end : end + 4096].translate(_FOLD)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        yield part
        at = end


def _filled(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: places and documents of each term, summed over all rows of ``docs``.

    A term is a longest stretch of ASCII letters (A-Z lowered) and characters beyond ASCII. Null text,
    language and source count as ''. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(*[_filled(c).cast("binary").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    names = ["lang", "source", "term", "n", "docs"]

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (language, origin), (places, texts) in held.items():
            terms = list(places)
            columns = [
                pa.array([language] * len(terms), pa.binary()),
                pa.array([origin] * len(terms), pa.binary()),
                pa.array(terms, pa.binary()),
                pa.array(list(places.values()), pa.int64()),
                pa.array(list(map(texts.__getitem__, terms)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                language, origin, body = (x.as_py() for x in row)
                places, texts = held.setdefault((language, origin), (Counter(), Counter()))
                before = len(places)
                own: set[bytes] = set()
                for piece in pieces(body):
                    found = piece.split()
                    places.update(found)
                    own.update(found)
                texts.update(own)
                size += len(places) - before
                if size > HELD_COUNTS or len(held) > HELD_COUNTS // 64:
                    yield from handed(held)
                    size = 0
        yield from handed(held)

    parts = rows.mapInArrow(count, "lang binary, source binary, term binary, n bigint, docs bigint")
    parts = parts.select(*[F.col(c).cast("string").alias(c) for c in names[:3]], "n", "docs")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def indicators(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the indicator matrix of a terms x sources matrix: ``places, owner, level``.

    Row i has ones in the columns ``places[i]``; column k stands for count ``level[k]`` in source ``owner[k]``.
    """
    levels, places, at = [], np.empty(counts.shape, np.int64), 0
    for k in range(counts.shape[1]):
        own, inverse = np.unique(counts[:, k], return_inverse=True)
        places[:, k] = inverse + at
        levels.append(own)
        at += len(own)
    owner = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    return places, owner, np.concatenate(levels) if levels else np.zeros(0, np.int64)


def joint_tables(places: np.ndarray, owner: np.ndarray, tile_columns: int = TILE_COLUMNS) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells ``(a, b, terms)`` of the joint tables of all sources: so many rows have ones in columns a and b, a's source first."""
    width = len(owner)
    for left in range(0, width, tile_columns):
        first = _one_hot(places, left, min(tile_columns, width - left))
        for right in range(left, width, tile_columns):
            # Entries are at most the number of rows, far below 2^24.
            product = first.T @ _one_hot(places, right, min(tile_columns, width - right))
            a, b = np.nonzero(product)
            terms = product[a, b].astype(np.int64)
            a, b = a + left, b + right
            wanted = owner[a] < owner[b]
            yield a[wanted], b[wanted], terms[wanted]


def block_sums(block: pd.DataFrame, tile_rows: int = TILE_ROWS) -> pd.DataFrame:
    """``source, item, high, low`` for every two sources of a block: the summed prices of its terms.

    ``block`` has ``source, term, n`` and, in rows with a null term, each source once with its ``total`` and the
    number ``kept`` of the language's terms. A source without a count for a term has it 0 times.
    """
    named = block["term"].isna().to_numpy()
    sources, s = np.unique(block["source"].to_numpy(object), return_inverse=True)
    sums = [1] * len(sources)
    for k, total, kept in zip(s[named], block["total"].to_numpy()[named], block["kept"].to_numpy()[named], strict=True):
        sums[k] = int(total) + int(kept)
    t, terms = pd.factorize(block["term"].to_numpy(object)[~named])
    s, n = s[~named], block["n"].to_numpy(np.int64)[~named]
    order = np.argsort(t, kind="stable")
    t, s, n = t[order], s[order], n[order]
    high, low = (np.zeros((len(sources), len(sources)), np.int64) for _ in range(2))
    for row in range(0, len(terms), tile_rows):
        part = slice(*np.searchsorted(t, (row, row + tile_rows)))
        counts = np.zeros((min(tile_rows, len(terms) - row), len(sources)), np.int64)
        counts[t[part] - row, s[part]] = n[part]
        places, owner, level = indicators(counts)
        # 1 + floor(SCALE * (count + 1) / sum) in Python's whole numbers, once for each column.
        share = np.array([1 + SCALE * (c + 1) // sums[k] for k, c in zip(owner.tolist(), level.tolist(), strict=True)], np.int64)
        for a, b, both in joint_tables(places, owner):
            p, q = share[a], share[b]
            square = (p - q) * (p - q)  # below 2^60
            for value, cell in ((square // q, (owner[a], owner[b])), (square // p, (owner[b], owner[a]))):
                np.add.at(high, cell, both * (value >> HALF))
                np.add.at(low, cell, both * (value & ((1 << HALF) - 1)))
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"source": sources[a], "item": sources[b], "high": high[a, b], "low": low[a, b]})


def _one_hot(places: np.ndarray, first: int, size: int) -> np.ndarray:
    """The columns ``first`` to ``first + size`` of the indicator matrix of some rows."""
    row, k = np.nonzero((places >= first) & (places < first + size))
    out = np.zeros((len(places), size), np.float32)
    out[row, places[row, k] - first] = 1
    return out


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    top = (count.cast("decimal(20,0)") + F.lit(1)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + kept).cast("decimal(20,0)")) + F.lit(1)


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): both are at most SCALE + 1, so the square fits a long."""
    apart = p.cast("bigint") - q.cast("bigint")
    return F.call_function("div", apart * apart, q.cast("bigint"))


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    listed: int = LISTED,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Part ``pair`` has the divergence from each other source of the language, part ``term`` the
    ``listed`` terms that set the source apart from its language most. A term counts if it is in
    ``least_documents`` documents (rows) of its language. Null text, language and source are ''. Ranks
    go by value descending, then item in UTF-8 order. A language with one source has no pairs, one
    without kept terms pairs of value 0 and no terms. An empty table gives no rows; other columns are ignored.
    """
    groups = docs.select(_filled(lang).alias("lang"), _filled(source).alias("source")).distinct()
    # A term's rows, one per source, meet once more for the sums over its language.
    of_term = W.partitionBy("lang", "term")
    sums = {"lang_n": F.sum("n").over(of_term), "d": F.sum("docs").over(of_term), "rn": F.row_number().over(of_term.orderBy("source"))}
    cells = counted(docs, text, lang, source).withColumns(sums).where(F.col("d") >= least_documents)
    cells = stored(cells.select("lang", "source", "term", "n", "lang_n", (F.col("rn") == 1).alias("first")), "divergence-cells")

    languages = cells.groupBy("lang").agg(
        F.count_if("first").alias("kept"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("cells")
    )
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = stored(
        groups.join(totals, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total", "cells")]),
        "divergence-sizes",
    )

    # Blocks of terms, with a row for each source of the language in each of its blocks.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cells") / F.lit(block_cells))).cast("int")
    number = sizes.where("kept > 0").select("lang", "source", "total", "kept", blocks.alias("blocks"))
    zero = F.lit(0).cast("bigint")
    named = number.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept").select(
        "lang", "block", "source", F.lit(None).cast("string").alias("term"), zero.alias("n"), "total", "kept"
    )
    placed = cells.join(number.select("lang", "blocks").distinct(), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", zero.alias("total"), zero.alias("kept")
    )

    def priced(group: tuple, block: pd.DataFrame) -> pd.DataFrame:
        out = block_sums(block)
        out.insert(0, "lang", group[0])
        return out

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sums = (
        placed.unionByName(named)
        .groupBy("lang", "block")
        .applyInPandas(priced, "lang string, source string, item string, high bigint, low bigint")
        .groupBy("lang", "source", "item")
        .agg((whole("high") * F.lit(1 << HALF).cast("decimal(10,0)") + whole("low")).cast("bigint").alias("value"))
    )
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value")
    )

    far = cells.join(sizes, ["lang", "source"])
    far = far.withColumns(
        {"p": probability(F.col("n"), F.col("total"), F.col("kept")), "q": probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}
    )
    apart = far.where("n > 0 AND p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value")
    )
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .unionByName(apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed))
        .select("lang", "source", "part", "item", "value", "rank")
    )
