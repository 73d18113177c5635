"""JSON texts: size-capped ingest, array unnesting, routing by a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import let


def _braced(text: Column) -> Column:
    """The outermost ``{...}`` parts of a text, however deep their braces nest."""
    tokens = F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]++"), F.lit(0))
    nothing = F.array().cast("array<struct<at:int,size:int>>")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("pos"), F.lit(1).alias("start"), nothing.alias("spans"))

    def step(state: Column, token: Column) -> Column:
        depth, pos, start, spans = (state.getField(n) for n in ("depth", "pos", "start", "spans"))
        opens, closes = token == "{", (token == "}") & (depth > 0)
        ended = F.array(F.struct(start.alias("at"), (pos - start + 1).alias("size")))
        return F.struct(
            (depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            (pos + F.length(token)).alias("pos"),
            F.when(opens & (depth == 0), pos).otherwise(start).alias("start"),
            F.when(closes & (depth == 1), F.concat(spans, ended)).otherwise(spans).alias("spans"),
        )

    spans = F.aggregate(tokens, begin, step, lambda state: state.getField("spans"))
    return F.transform(spans, lambda s: F.substring(text, s.getField("at"), s.getField("size")))


def check_documents(df: DataFrame, raw: str, max_bytes: int) -> DataFrame:
    """``error`` per JSON text: too large, not JSON, or null for a good one; ``doc`` is a VARIANT."""
    text = F.col(raw)
    size = F.octet_length(text)
    rows = df.withColumn("doc", F.when(size <= max_bytes, F.try_parse_json(text)))
    error = F.when(size > max_bytes, F.concat(F.lit("The document has more than "), F.lit(str(max_bytes)), F.lit(" bytes"))).when(
        F.col("doc").isNull(), F.lit("The document is not valid JSON")
    )
    return rows.withColumn("error", error)


def good_documents(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull())


def bad_documents(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).drop("doc")


def explode_array(df: DataFrame, raw: str) -> DataFrame:
    """One row per top-level object of a JSON array, as JSON text in ``item`` with its ``pos``.

    Items that are not objects are skipped, and so are texts that are not arrays. An array that
    does not parse as a whole yields the objects in it that do.
    """
    text = F.col(raw)
    whole = F.from_json(text, "array<variant>", {"mode": "PERMISSIVE"})
    items = F.coalesce(F.col("__whole"), F.transform(_braced(text), F.try_parse_json))
    is_object = lambda item: item.startswith("{")
    arrays = df.where(F.ltrim(text).startswith("[")).withColumn("__whole", whole)
    texts = F.filter(F.transform(items, lambda v: F.to_json(v)), is_object)
    return arrays.withColumn("__texts", texts).select(*df.columns, F.posexplode("__texts").alias("pos", "item"))


def skipped_items(raw: Column) -> Column:
    """How many items of a JSON array :func:`explode_array` leaves out; null for a text that is no array.

    Of an array that does not parse as a whole these are the closed objects that do not parse.
    """
    whole = F.from_json(raw, "array<variant>", {"mode": "PERMISSIVE"})
    others = lambda items: F.size(F.filter(F.transform(items, lambda v: F.to_json(v)), lambda item: ~item.startswith("{")))
    broken = F.size(F.filter(F.transform(_braced(raw), F.try_parse_json), F.isnull))
    return F.when(F.ltrim(raw).startswith("["), let(whole, lambda w: F.when(w.isNull(), broken).otherwise(others(w))))


def route_by_field(df: DataFrame, raw: str, field: str = "table") -> DataFrame:
    """Adds ``route`` (the text at ``field``) and ``error`` without parsing whole documents."""
    text = F.col(raw)
    route = F.get_json_object(text, f"$.{field}")
    error = F.when(~F.ltrim(text).startswith("{"), F.lit("The text is no JSON object")).when(
        route.isNull(), F.lit(f"The object has no field {field}")
    )
    return df.withColumns({"route": F.when(error.isNull(), route), "error": error})
