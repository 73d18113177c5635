"""Scalar functions (section H) and user stages (section J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import SyncTask
from driftline.functions import errors, identifiers, jsondocs, pgtypes, positions, values
from driftline.plans.sync import run_task
from driftline.workload.base import GAPS, Tables, query


@query(
    "h01_to_string",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS number, CAST(value AS VARCHAR) AS fraction, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS flag,
    CASE WHEN event_type = 'view' THEN 'null' ELSE event_type END AS word, '{"u":' || user_id || '}' AS object,
    CAST(CAST(value * 1000000 AS BIGINT) AS VARCHAR) || '.5' AS large FROM events""",
)
def to_string(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.col("user_id").alias("number"),
        F.col("value").alias("fraction"),
        (F.col("value") > 50).alias("flag"),
        F.expr("nullif(event_type, 'view')").alias("word"),
        F.struct(F.col("user_id").alias("u")).alias("object"),
        (F.round(F.col("value") * 1000000) + 0.5).alias("large"),
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name != "event_id"}
    return rows.select("event_id", *[values.json_text(F.col(n), k).alias(n) for n, k in kinds.items()])


@query(
    "h02_to_number",
    """SELECT event_id, value AS number, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN CAST(CAST(value AS VARCHAR) || 'e2' AS DOUBLE) WHEN 'signup' THEN NULL END AS parsed,
    event_type NOT IN ('click', 'view') AS failed FROM events""",
)
def to_number(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("+"), F.col("value").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.col("value").cast("string"), F.lit("e2")))
        .when(F.col("event_type") == "signup", " 12d")
        .when(F.col("event_type") == "error", "0x1F")
    )
    number, error = values.to_number(F.col("text"), T.StringType())
    rows = t.events.select("event_id", "value", "event_type", text.alias("text"))
    return rows.select(
        "event_id",
        values.to_number(F.col("value"), T.DoubleType())[0].alias("number"),
        number.alias("parsed"),
        error.isNotNull().alias("failed"),
    )


@query(
    "h03_to_boolean",
    "SELECT event_id, event_type IN ('click', 'signup') AS word, k > 0 AS number FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
)
def to_boolean(t: Tables) -> DataFrame:
    word = F.expr("CASE event_type WHEN 'click' THEN 'tRUE' WHEN 'signup' THEN '1' WHEN 'error' THEN 'yes' END")
    number = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select("event_id", word.alias("word"), number.alias("number"))
    return rows.select(
        "event_id",
        values.to_boolean(F.col("word"), T.StringType()).alias("word"),
        values.to_boolean(F.col("number"), T.IntegerType()).alias("number"),
    )


@query("h04_to_array", """SELECT event_id, '["' || event_type || '"]' AS wrapped, '[' || user_id || ',' || event_id || ']' AS kept FROM events""")
def to_array(t: Tables) -> DataFrame:
    kept = F.array("user_id", "event_id")
    return t.events.select(
        "event_id",
        F.to_json(values.to_array(F.col("event_type"), T.StringType())).alias("wrapped"),
        F.to_json(values.to_array(kept, T.ArrayType(T.LongType()))).alias("kept"),
    )


@query(
    "h05_composite_text",
    f"WITH {GAPS} SELECT event_id, coalesce(kind, '') AS kind, coalesce(CAST(amount AS VARCHAR), '') AS amount FROM gaps",
)
def composite_text(t: Tables) -> DataFrame:
    return t.gaps.select(
        "event_id",
        values.composite_text(F.col("kind"), T.StringType()).alias("kind"),
        values.composite_text(F.col("amount"), T.DoubleType()).alias("amount"),
    )


@query(
    "h06_path_walk",
    """SELECT event_id, value AS deep, event_type AS first, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS none FROM events""",
)
def path_walk(t: Tables) -> DataFrame:
    doc = F.struct(
        F.struct(F.array(F.struct(F.col("value").alias("v"))).alias("b")).alias("a"),
        F.create_map(F.lit("x"), F.array("event_type")).alias("m"),
        F.parse_json(F.concat(F.lit('{"list": [0, '), F.col("props"), F.lit("]}"))).alias("j"),
    )
    rows = t.events.select("event_id", doc.alias("doc"))
    kind = rows.schema["doc"].dataType
    walk = lambda path: values.walk_path(F.col("doc"), kind, path)[0]
    return rows.select(
        "event_id",
        walk("a.b.0.v").alias("deep"),
        walk("m.x.0").alias("first"),
        walk("j.list.1.k").cast("bigint").alias("k"),
        walk("j.list.9.k").cast("string").alias("none"),
    )


@query(
    "h07_position_parse",
    """SELECT event_id, CAST(event_id % 40 AS BIGINT) AS hi, event_id * 65537 % 4294967296 AS lo, (event_id % 40) * 4294967296 + event_id * 65537 % 4294967296 AS num,
    CASE WHEN event_id % 40 > 5 OR (event_id % 40 = 5 AND event_id * 65537 % 4294967296 > 65536) THEN 1
         WHEN event_id % 40 = 5 AND event_id * 65537 % 4294967296 = 65536 THEN 0 ELSE -1 END AS against, 0 AS bad FROM events""",
)
def position_parse(t: Tables) -> DataFrame:
    hi, lo = F.col("event_id") % 40, (F.col("event_id") * 65537) % F.lit(4294967296)
    rows = t.events.select("event_id", F.concat(F.lower(F.hex(hi)), F.lit("/"), F.hex(lo)).alias("lsn"))
    halves = positions.lsn_halves(F.col("lsn"))
    return rows.select(
        "event_id",
        halves.getField("hi").cast("bigint").alias("hi"),
        halves.getField("lo").cast("bigint").alias("lo"),
        positions.lsn_number(F.col("lsn")).cast("bigint").alias("num"),
        positions.lsn_compare(F.col("lsn"), F.lit("5/10000")).alias("against"),
        positions.lsn_number(F.concat(F.lit("xy/"), F.lit("zz"))).cast("int").alias("bad"),
    )


@query(
    "h08_position_display",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pg:0/' || to_hex(event_id) WHEN 1 THEN 'mysql:bin.' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || event_id
      ELSE 'mongo:tok' || event_id END AS shown,
    CASE event_id % 3 WHEN 0 THEN event_id > 500 WHEN 1 THEN user_id > 75 OR (user_id = 75 AND event_id > 500) ELSE false END AS later FROM events""",
)
def position_display(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("postgresql"), F.lit("mysql"), F.lit("mongodb")), (F.col("event_id") % 3 + 1).cast("int"))
    file = lambda user: F.concat(F.lit("bin."), F.lpad(user.cast("string"), 6, "0"))
    first = (
        F.when(F.col("kind") == "postgresql", positions.lsn_text(F.col("event_id")))
        .when(F.col("kind") == "mysql", file(F.col("user_id")))
        .otherwise(F.concat(F.lit("tok"), F.col("event_id").cast("string")))
    )
    rows = t.events.select("event_id", "user_id", kind.alias("kind")).withColumn("first", first)
    here = F.struct("first", F.col("event_id").alias("second"))
    mark = F.when(F.col("kind") == "mysql", F.lit("bin.000075")).otherwise("0/1F4")
    there = F.struct(mark.alias("first"), F.lit(500).alias("second"))
    return rows.select(
        "event_id",
        positions.position_display(F.col("kind"), F.col("first"), F.col("event_id")).alias("shown"),
        positions.position_is_after(F.col("kind"), here, there).alias("later"),
    )


@query(
    "h09_table_key",
    """SELECT DISTINCT lang || '.' || lower(source) AS key, lang || '.' || source AS name, lower(source) AS bare FROM documents""",
)
def table_key(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source").distinct()
    name = F.concat(F.lit('  "'), F.upper("lang"), F.lit('"."'), F.col("source"), F.lit('" '))
    schema, table = identifiers.split_schema(name), identifiers.split_table(name)
    return rows.select(
        identifiers.table_key(table, schema).alias("key"),
        F.concat(F.lower(schema), F.lit("."), table).alias("name"),
        identifiers.table_key(table, F.lit("  ")).alias("bare"),
    )


@query(
    "h10_scalar_decode",
    """SELECT event_id, event_id % 2 = 0 AS b, CASE WHEN event_id > 32767 THEN 0 ELSE event_id END AS i2, event_id AS i8, value AS f8, 0.0::DOUBLE AS bad,
    CAST(value * 1000 AS DECIMAL(18, 2))::DOUBLE AS money, CAST(value AS DECIMAL(18, 2))::DOUBLE AS numeric_value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS js,
    strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def scalar_decode(t: Tables) -> DataFrame:
    text = F.col("event_id").cast("string")
    money = F.concat(F.lit("$"), F.format_number(F.col("value") * 1000, 2))
    cells = {
        "b": (F.when(F.col("event_id") % 2 == 0, "t").otherwise("f"), "bool"),
        "i2": (text, "int2"),
        "i8": (text, "int8"),
        "f8": (F.col("value").cast("string"), "float8"),
        "bad": (F.col("event_type"), "float8"),
        "money": (money, "money"),
        "numeric_value": (F.col("value").cast("string"), "numeric"),
        "js": (F.col("props"), "jsonb"),
        "day": (F.date_format("ts", "yyyy-MM-dd"), "date"),
    }
    rows = t.events.select("event_id", *[c.alias(n) for n, (c, _) in cells.items()])
    made = {n: pgtypes.decode_scalar(F.col(n), kind) for n, (_, kind) in cells.items()}
    made["i2"] = made["i2"].cast("bigint")
    made["money"], made["numeric_value"] = made["money"].cast("double"), made["numeric_value"].cast("double")
    made["js"] = F.try_variant_get(made["js"], "$.k", "bigint")
    return rows.withColumns(made)


@query(
    "h11_array_decode",
    """SELECT event_id, event_id + user_id AS total, CAST(3 AS INTEGER) AS n, event_type || ',"x\\' AS second, '' AS blank, NULL::VARCHAR AS raw_kept FROM events""",
)
def array_decode(t: Tables) -> DataFrame:
    numbers = F.concat(F.lit("{"), F.col("event_id"), F.lit(",NULL,"), F.col("user_id"), F.lit("}"))
    words = F.concat(F.lit('{a b,"'), F.col("event_type"), F.lit(',\\"x\\\\",""}'))
    rows = t.events.select("event_id", numbers.alias("numbers"), words.alias("words"), F.lit("none").alias("plain"))
    ints, texts = pgtypes.decode(F.col("numbers"), 1016), pgtypes.decode(F.col("words"), 1009)
    total = F.aggregate(ints, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")))
    return rows.select(
        "event_id",
        total.alias("total"),
        F.size(ints).alias("n"),
        F.get(texts, F.lit(1)).alias("second"),
        F.get(texts, F.lit(2)).alias("blank"),
        F.array_join(pgtypes.decode(F.col("plain"), 1009), ",").alias("raw_kept"),
    )


@query(
    "h11_malformed_array",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{' || event_type WHEN event_id % 3 = 1 THEN event_type END AS raw,
    CASE WHEN event_id % 3 = 2 THEN 1 END AS n FROM events""",
)
def malformed_array(t: Tables) -> DataFrame:
    """Two of three texts are no array literals and stay as they are."""
    third = F.col("event_id") % 3
    text = F.concat(F.when(third == 1, "").otherwise("{"), F.col("event_type"), F.when(third == 2, "}").otherwise(""))
    rows = t.events.select("event_id", text.alias("text"))
    return rows.select("event_id", pgtypes.malformed_array(F.col("text")).alias("raw"), F.size(pgtypes.decode(F.col("text"), 1009)).alias("n"))


@query("h12_unquote", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def unquote(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit(" '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("' "))
    return t.documents.select("doc_id", F.md5(pgtypes.unquote(quoted)).alias("text_md5"), pgtypes.unquote(F.col("lang")).alias("lang"))


@query(
    "h13_numeric_compare",
    "SELECT event_id, event_id > 500.5 AS whole, value < 20 AS fraction FROM events",
)
def numeric_compare(t: Tables) -> DataFrame:
    from driftline.config import Condition
    from driftline.operators.conditions import flag

    schema = t.events.schema
    return t.events.select(
        "event_id",
        flag(Condition("greater_than", "event_id", 500.5), schema).alias("whole"),
        flag(Condition("less_than", "value", 20), schema).alias("fraction"),
    )


@query("h14_first_line", "SELECT doc_id, CASE WHEN text <> '' THEN rtrim(split_part(text, chr(10), 1), chr(13)) END AS line FROM documents")
def first_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", errors.first_line(F.col("text")).alias("line"))


@query("h15_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def rfc3339(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsondocs.rfc3339(F.col("ts").cast("timestamp")).alias("at"))


@query("h16_byte_length", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CAST(length(html) AS BIGINT) AS chars FROM pages")
def byte_length(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", F.octet_length("html").cast("bigint").alias("bytes"), F.char_length("html").cast("bigint").alias("chars")
    )


@query(
    "h17_json_edit",
    """SELECT event_id, event_type = 'click' AS on_sale, CASE event_type WHEN 'click' THEN '["sale","x"]' ELSE '["' || event_type || '","sale"]' END AS tags,
    '{"discount_percent":' || user_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS attributes, '{"by":"cron","id":' || event_id || '}' AS built FROM events""",
)
def json_edit(t: Tables) -> DataFrame:
    tags = F.when(F.col("event_type") == "click", '["sale","x"]').otherwise(F.to_json(F.array("event_type")))
    rows = t.events.withColumn("tags", tags)
    added = jsondocs.json_object_add(F.col("props"), discount_percent=F.col("user_id"))
    in_order = F.from_json(added, "discount_percent bigint, k bigint")
    return rows.select(
        "event_id",
        jsondocs.json_array_has(F.col("tags"), "sale").alias("on_sale"),
        jsondocs.json_array_add(F.col("tags"), "sale").alias("tags"),
        F.to_json(in_order).alias("attributes"),
        jsondocs.json_object(by=F.lit("cron"), id=F.col("event_id")).alias("built"),
    )


@query(
    "h18_shipped_sql_functions",
    """SELECT p_partkey, greatest(0, p_size - 25) AS stock, floor(p_retailprice)::BIGINT AS whole, 'AUTO-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS sku,
    CASE p_partkey % 4 WHEN 0 THEN 'Books' WHEN 1 THEN 'Office' ELSE 'Other' END AS category, round(CAST(p_retailprice AS DECIMAL(18, 2)) * 0.9, 1)::DOUBLE AS price FROM part""",
)
def shipped_sql_functions(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey",
        "greatest(0, p_size - 25) AS stock",
        "floor(p_retailprice) AS whole",
        "concat('AUTO-', lpad(cast(p_partkey AS string), 9, '0')) AS sku",
        "CASE p_partkey % 4 WHEN 0 THEN 'Books' WHEN 1 THEN 'Office' ELSE 'Other' END AS category",
        "cast(round(cast(p_retailprice AS decimal(18, 2)) * 0.9, 1) AS double) AS price",
    )


@query(
    "h18_epoch_and_date",
    "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def epoch_and_date(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("seconds"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
    )


TEXTS = {
    "signup": "HTTP 429: Too Many Requests",
    "view": "operation timed out after 30s",
    "click": "permission denied for table x",
    "purchase": "index 'items' not found",
    "error": "connection reset by peer",
}


@query(
    "h19_error_class",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'rate_limit' WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'permission'
    WHEN 'purchase' THEN 'not_found' ELSE 'network' END AS error_class FROM events""",
)
def error_class(t: Tables) -> DataFrame:
    texts = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])
    return t.events.select("event_id", errors.error_class(F.try_element_at(texts, F.col("event_type"))).alias("error_class"))


@query(
    "j01_user_stage",
    "SELECT c_custkey, sha256(c_name) AS c_name_hash, c_acctbal, c_acctbal > 5000 AS rich FROM customer",
)
def user_stage(t: Tables) -> DataFrame:
    """A user's own steps at the end of a task: any function from DataFrame to DataFrame."""

    def hash_name(df: DataFrame) -> DataFrame:
        return df.withColumn("c_name_hash", F.sha2("c_name", 256)).drop("c_name")

    def mark_rich(df: DataFrame) -> DataFrame:
        return df.withColumn("rich", F.col("c_acctbal") > 5000)

    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    task = SyncTask("customers", "public.customer", "customers", ("c_custkey",))
    return run_task(rows, task, full_sync=True, stages=[hash_name, mark_rich]).accepted
