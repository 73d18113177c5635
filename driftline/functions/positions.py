"""Log positions: parsing, ordering and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.values import let

# Fixed value: an LSN half that parses as hexadecimal.
HEX_TEXT = r"^\+?[0-9A-Fa-f]+$"
PLAIN_LSN = r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def _half(c: Column) -> Column:
    digits = F.ltrim(F.regexp_replace(c, r"^\+", ""), F.lit("0"))

    def number(d: Column) -> Column:
        return F.when((F.length(d) <= 16) & (d != ""), F.conv(d, 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0))

    return F.when(c.rlike(HEX_TEXT), let(digits, number)).otherwise(F.lit(0))


def lsn_halves(lsn: Column) -> Column:
    """``struct(hi, lo)`` of an ``hi/lo`` position; null when the text has another shape."""

    def halves(parts: Column) -> Column:
        half = lambda i: _half(F.get(parts, F.lit(i))).cast("decimal(20,0)")
        return F.when(F.size(parts) == 2, F.struct(half(0).alias("hi"), half(1).alias("lo")))

    return let(F.split(lsn, "/"), halves)


def lsn_number(lsn: Column) -> Column:
    """Position as one sortable number: high half times 2^32 plus low half."""
    joined = F.concat(F.substring_index(lsn, "/", 1), F.lpad(F.substring_index(lsn, "/", -1), 8, "0"))
    halves = lsn_halves(lsn)
    wide = halves.getField("hi") * F.lit(4294967296).cast("decimal(10,0)") + halves.getField("lo")
    return F.when(lsn.rlike(PLAIN_LSN), F.conv(joined, 16, 10).cast("decimal(20,0)")).otherwise(
        wide.try_cast("decimal(20,0)")
    )


def lsn_text(number: Column) -> Column:
    """Inverse of :func:`lsn_number` for a BIGINT position."""
    n = number.cast("bigint")
    return F.concat(F.hex(F.shiftright(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(4294967295))))


def lsn_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; numeric when both look like positions, by text otherwise."""

    def sign(x: Column, y: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0))

    both = F.struct(lsn_halves(left).alias("a"), lsn_halves(right).alias("b"))

    def compare(p: Column) -> Column:
        a, b = p.getField("a"), p.getField("b")
        return F.when(a.isNotNull() & b.isNotNull(), sign(a, b)).otherwise(sign(left, right))

    return let(both, compare)


def position_display(kind: Column, first: Column, second: Column) -> Column:
    """``pg:lsn``, ``mysql:file:pos`` or ``mongo:token``; ``second`` is only used by mysql."""
    prefix = F.when(kind == "postgresql", "pg").when(kind == "mysql", "mysql").when(kind == "mongodb", "mongo")
    return F.when(kind == "mysql", F.concat_ws(":", prefix, first, second.cast("string"))).otherwise(
        F.concat_ws(":", prefix, first)
    )


def position_is_after(kind: Column, left: Column, right: Column) -> Column:
    """Strict order of ``struct(first, second)`` positions of one source kind.

    Positions of other kinds, or malformed ones, are never after one another.
    """
    mysql = F.struct(left.getField("first"), left.getField("second").cast("bigint")) > F.struct(
        right.getField("first"), right.getField("second").cast("bigint")
    )
    postgres = lsn_halves(left.getField("first")) > lsn_halves(right.getField("first"))
    return F.coalesce(F.when(kind == "postgresql", postgres).when(kind == "mysql", mysql), F.lit(False))
