"""Error text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_line(text: Column) -> Column:
    """First line without its line end; null for an empty text."""
    line = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"\r$", "")
    return F.when(text != "", line)


def error_label(error: Column) -> Column:
    return F.coalesce(first_line(error), F.lit("Unknown"))


# Our own mapping from error wording to class; the first match wins.
CLASS_PATTERNS = {
    "rate_limit": r"(?i)rate.?limit|too many requests|\b429\b",
    "timeout": r"(?i)time(d)?.?out|deadline",
    "permission": r"(?i)permission|forbidden|unauthori[sz]ed|access denied|\b40[13]\b",
    "not_found": r"(?i)not found|does not exist|\b404\b",
    "network": r"(?i)network|connection|unreachable|reset by peer|dns",
    "data_validation": r"(?i)cannot convert|is no |no conversion|invalid|not valid|parse|validation|missing .*field|has no field|exceeds|more than \d+ bytes",
}


def error_class(error: Column) -> Column:
    result = F.when(F.lit(False), F.lit(""))
    for name, pattern in CLASS_PATTERNS.items():
        result = result.when(error.rlike(pattern), F.lit(name))
    return result.otherwise(F.lit("unknown"))
