"""Sources, envelopes, merges, dead letters and progress (section A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import Convert, SyncTask, Transforms
from driftline.functions.positions import lsn_number, lsn_text
from driftline.functions.sizes import document_size
from driftline.operators import LSN, OP, UNCHANGED, asof, deadletters, merge, progress
from driftline.plans.sync import run_task
from driftline.session import scratch_path
from driftline.sources import changelog, documents, tables
from driftline.sources.deadletter_table import DeadLetterTable
from driftline.sources.keyed_table import KeyedTable
from driftline.workload.base import DELIVERIES, LOG, SNAPSHOT, SEGMENT, Tables, query


@query(
    "a01_full_table_scan",
    """SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS pk,
    CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
                  'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS doc FROM customer""",
)
def full_table_scan(t: Tables) -> DataFrame:
    return tables.documents(t.customer, ["c_custkey"], "customer")


@query(
    "a02_change_log_scan",
    f"""WITH {LOG} SELECT '0/' || to_hex(event_id) AS lsn, event_id AS lsn_num, op, 'public' AS schema_name,
    event_type AS table_name, CAST(k AS VARCHAR) AS pk, value, ts FROM chg""",
)
def change_log_scan(t: Tables) -> DataFrame:
    rows = t.log.withColumn("lsn", lsn_text(F.col("event_id")))
    return rows.select(
        "lsn",
        lsn_number(F.col("lsn")).cast("bigint").alias("lsn_num"),
        "op",
        F.lit("public").alias("schema_name"),
        F.col("event_type").alias("table_name"),
        F.col("k").cast("string").alias("pk"),
        "value",
        "ts",
    )


def document_lines(t: Tables) -> DataFrame:
    """Each document as one change line between BEGIN and COMMIT, written as the log writes it."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    key = F.concat(F.lit(" doc_id[bigint]:"), F.col("doc_id").cast("string"))
    body = F.concat(
        key,
        F.lit(" text[text]:"),
        quoted(F.col("text")),
        F.lit(" source[character varying]:"),
        F.when(F.col("lang") == "es", "null").otherwise(quoted(F.col("source"))),
        F.lit(" n_chars[bigint]:"),
        F.col("n_chars").cast("string"),
    )
    line = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("UPDATE: old-key:"), key, F.lit(" new-tuple:"), body))
        .when(F.col("lang") == "de", F.concat(F.lit("DELETE:"), key))
        .otherwise(F.concat(F.lit("INSERT:"), body))
    )
    lines = F.array(
        F.concat(F.lit("BEGIN "), F.col("doc_id").cast("string")),
        F.concat(F.lit("table app."), F.col("lang"), F.lit("_documents: "), line),
        F.concat(F.lit("COMMIT "), F.col("doc_id").cast("string")),
    )
    return t.documents.select(F.posexplode(lines).alias("pos", "data"))


@query(
    "a03_text_line_decode",
    """SELECT 'app' AS schema_name, lang || '_documents' AS table_name,
    CASE lang WHEN 'fr' THEN 'update' WHEN 'de' THEN 'delete' ELSE 'create' END AS op, doc_id,
    CASE WHEN lang <> 'de' THEN md5(text) END AS text_md5,
    CASE WHEN lang NOT IN ('de', 'es') THEN source END AS source,
    CASE WHEN lang <> 'de' THEN n_chars END AS n_chars,
    CASE WHEN lang = 'fr' THEN doc_id END AS old_doc_id FROM documents""",
)
def text_line_decode(t: Tables) -> DataFrame:
    rows = changelog.decode_lines(document_lines(t))
    rows = changelog.typed_fields(rows, {"doc_id": "int8", "text": "text", "source": "text", "n_chars": "int8"})
    old = changelog.field_text(F.col("old_fields"), "doc_id").cast("bigint")
    return rows.select(
        "schema_name",
        "table_name",
        "op",
        "doc_id",
        F.md5("text").alias("text_md5"),
        "source",
        "n_chars",
        old.alias("old_doc_id"),
    )


@query(
    "a04_value_inference",
    """SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","amount":' || CAST(value AS VARCHAR)
    || ',"code":' || json_extract_string(props, '$.k') || ',"flag":' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END
    || ',"blank":null,"note":"it''s [x]: y"}' AS doc FROM events""",
)
def value_inference(t: Tables) -> DataFrame:
    line = F.concat(
        F.lit("table public.events: INSERT: id[bigint]:"),
        F.col("event_id").cast("string"),
        F.lit(" kind[text]:'"),
        F.col("event_type"),
        F.lit("' amount[text]:'"),
        F.col("value").cast("string"),
        F.lit("' code[text]:'00"),
        F.get_json_object("props", "$.k"),
        F.lit("' flag[text]:'"),
        F.when(F.col("value") > 50, "TRUE").otherwise("False"),
        F.lit("' blank[text]:'' note[text]:'it''s [x]: y'"),
    )
    rows = changelog.decode_lines(t.events.select("event_id", line.alias("data")))
    return rows.select("event_id", changelog.inferred_json(F.col("fields")).alias("doc"))


@query("a05_positioned_scan", "SELECT event_id, event_type, value FROM events WHERE event_id > 499")
def positioned_scan(t: Tables) -> DataFrame:
    return changelog.after(t.events, 499, "event_id").select("event_id", "event_type", "value")


@query(
    "a06_replay_range",
    "SELECT event_id, event_type, user_id FROM events WHERE event_id BETWEEN 100 AND 1000000000000000",
)
def replay_range(t: Tables) -> DataFrame:
    rows = changelog.replay(t.events, 100, 10**15, lsn="event_id", table="event_type")
    return rows.select("event_id", "event_type", "user_id")


@query(
    "a06_replay_dry_run",
    """SELECT event_type, count(*) AS events, min(event_id) AS first_lsn, max(event_id) AS last_lsn
    FROM events WHERE event_id BETWEEN 100 AND 1000000000000000 GROUP BY event_type""",
)
def replay_dry_run(t: Tables) -> DataFrame:
    return changelog.replay_plan(t.events, 100, 10**15, lsn="event_id", table="event_type")


@query(
    "a07_multi_source_union",
    """SELECT 'crm' AS source_name, c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer
    UNION ALL SELECT 'erp', s_suppkey, s_name, s_acctbal, NULL FROM supplier
    UNION ALL SELECT 'shop', p_partkey, p_name, NULL, p_brand FROM part""",
)
def multi_source_union(t: Tables) -> DataFrame:
    named = {
        "crm": t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance"),
        "erp": t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"),
        "shop": t.part.selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand"),
    }
    return tables.union_sources(named)


@query(
    "a08_envelope",
    f"""WITH {LOG} SELECT op AS event_type, 'public' AS schema, event_type AS table_name, CAST(k AS VARCHAR) AS key,
    CASE WHEN op = 'delete' THEN value END AS old_value, CASE WHEN op <> 'delete' THEN value END AS new_value,
    '0/' || to_hex(event_id) AS position, CAST(event_id // 10 AS VARCHAR) AS transaction_id, ts AS at FROM chg""",
)
def envelope(t: Tables) -> DataFrame:
    rows = t.log.select(
        "op",
        F.lit("public").alias("schema_name"),
        F.col("event_type").alias("table_name"),
        lsn_text(F.col("event_id")).alias("lsn"),
        F.floor(F.col("event_id") / 10).alias("xid"),
        "ts",
        F.struct(F.col("k").alias("_id"), "value", "props").alias("data"),
    )
    return changelog.envelope(rows).select(
        "event_type",
        F.col("source.schema").alias("schema"),
        F.col("source.table").alias("table_name"),
        F.col("data.key").alias("key"),
        F.col("data.old.value").alias("old_value"),
        F.col("data.new.value").alias("new_value"),
        F.col("metadata.position").alias("position"),
        F.col("metadata.transaction_id").alias("transaction_id"),
        F.col("timestamp").alias("at"),
    )


KINDS = {"signup": "insert", "view": "update", "error": "delete", "click": "cdc", "purchase": "full_sync"}


@query(
    "a09_stream_envelope",
    """SELECT CASE event_type WHEN 'view' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'delete' ELSE 'create' END
        AS event_type,
      CASE event_type WHEN 'click' THEN 'app' ELSE 'public' END AS schema, 'items' AS table_name,
      CAST(event_id AS VARCHAR) AS key,
      CASE WHEN event_type IN ('view', 'error') THEN value - 1 END AS old_value,
      CASE WHEN event_type <> 'error' THEN value END AS new_value FROM events
    UNION ALL SELECT 'create', 'system', 'control', NULL, NULL, NULL FROM region""",
)
def stream_envelope(t: Tables) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    image = lambda v: F.struct(F.col("event_id").alias("id"), v.alias("value"))
    rows = t.events.select(
        F.try_element_at(kinds, F.col("event_type")).alias("kind"),
        F.lit("delete").alias("op"),
        F.lit("app").alias("schema_name"),
        F.lit("items").alias("table_name"),
        image(F.col("value") - 1).alias("old"),
        image(F.col("value")).alias("new"),
    )
    control = t.region.select(F.when(F.col("r_regionkey") > 2, "heartbeat").otherwise("checkpoint").alias("kind"))
    both = rows.unionByName(control, allowMissingColumns=True)
    return changelog.stream_envelope(both).select(
        "event_type",
        "schema",
        F.col("table").alias("table_name"),
        "key",
        F.col("old.value").alias("old_value"),
        F.col("new.value").alias("new_value"),
    )


@query(
    "a11_document_ingest",
    """WITH raw AS (SELECT doc_id, lang, strlen(CAST(to_json({'doc_id': doc_id, 'text': text}) AS VARCHAR)) AS bytes FROM documents)
    SELECT doc_id, CASE WHEN lang = 'de' THEN bytes - 1 ELSE bytes END AS bytes,
      CASE WHEN (CASE WHEN lang = 'de' THEN bytes - 1 ELSE bytes END) > 2048 THEN 'The document has more than 2048 bytes'
           WHEN lang = 'de' THEN 'The document is not valid JSON' END AS error,
      CASE WHEN bytes <= 2048 AND lang <> 'de' THEN doc_id END AS parsed_id FROM raw""",
)
def document_ingest(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct("doc_id", "text"))
    raw = F.when(F.col("lang") == "de", F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    checked = documents.check_documents(t.documents.select("doc_id", raw.alias("raw")), "raw", 2048)
    return checked.select(
        "doc_id",
        F.octet_length("raw").cast("bigint").alias("bytes"),
        "error",
        F.try_variant_get("doc", "$.doc_id", "bigint").alias("parsed_id"),
    )


@query(
    "a12_json_array_explode",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)
    SELECT event_id, 0 AS pos, '{"id":' || event_id || ',"p":{"k":' || n || '}}' AS item FROM e
    UNION ALL SELECT event_id, 1, '{"t":"' || event_type || '"}' FROM e""",
)
def json_array_explode(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit('[{"id":'),
        F.col("event_id").cast("string"),
        F.lit(',"p":'),
        F.col("props"),
        F.lit('}, 7, "x", [1, {"in": 2}], null,\n {"t": "'),
        F.col("event_type"),
        F.lit('"}]'),
    )
    return documents.explode_array(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "pos", "item")


@query(
    "a13_route_raw_json",
    """SELECT event_id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN event_type END AS route,
    CASE event_type WHEN 'error' THEN 'The text is no JSON object' WHEN 'purchase' THEN 'The object has no field table' END AS error FROM events""",
)
def route_raw_json(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.lit("not json"))
        .when(kind == "purchase", F.concat(F.lit('{"id": 1, "in": {"table": "x"}, "p": '), "props", F.lit("}")))
        .otherwise(F.concat(F.lit('  {  "p": '), "props", F.lit(', "table"  :  "'), kind, F.lit('" }')))
    )
    routed = documents.route_by_field(t.events.select("event_id", raw.alias("raw")), "raw")
    return routed.select("event_id", "route", "error")


@query(
    "a14_document_size",
    """SELECT doc_id, 24 + (24 + 6) + (24 + 4) + (24 + 4) + (24 + 6) + (24 + 7) + 16 + 16
      + CASE WHEN text IS NULL THEN 8 ELSE 24 + strlen(text) END
      + CASE WHEN lang IS NULL THEN 8 ELSE 24 + strlen(lang) END
      + CASE WHEN source IS NULL THEN 8 ELSE 24 + strlen(source) END AS bytes FROM documents""",
)
def document_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", document_size(t.documents.schema).alias("bytes"))


@query(
    "a14_variant_size",
    """SELECT event_id, 24 + (24 + 3) + 24 + (24 + 2) + 16 + (24 + 1) + 24 + (24 + 1) + 16 + (24 + 4) + 24 + (24 + 4)
      + (24 + strlen(event_type)) + 8 + 8 AS bytes FROM events""",
)
def variant_sizes(t: Tables) -> DataFrame:
    """Nested values of every kind, one text with an escape and a letter of two bytes."""
    raw = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"p":'), F.col("props"),
        F.lit(',"tags":["\u00e9\\n!","'), F.col("event_type"), F.lit('",null,true]}'),
    )
    docs = t.events.select("event_id", F.parse_json(raw).alias("doc"))
    return docs.select("event_id", document_size(docs.select("doc").schema).alias("bytes"))


@query(
    "a14_array_document_size",
    """SELECT vec_id, 24 + (24 + 6) + 16 + (24 + 9) + 24 + 16 * len(embedding) + (24 + 5)
      + CASE WHEN label IS NULL THEN 8 ELSE 16 END AS bytes FROM embeddings""",
)
def array_document_sizes(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", document_size(t.embeddings.schema).alias("bytes"))


RELATION = {"id": 20, "kind": 25, "amount": 701}


def relation_decode_plan(t: Tables) -> DataFrame:
    column = lambda n: F.struct(F.lit(n).alias("name"), F.lit(RELATION[n]).alias("type_id"))
    plain = F.array(column("id"), column("kind"), column("amount"))
    swapped = F.array(column("kind"), column("id"))
    versions = t.log.where("op = 'create'").select(
        F.col("k").alias("relation_id"),
        F.col("event_id").alias("lsn_num"),
        F.col("event_id").alias("version"),
        F.when(F.col("event_id") % 2 == 0, plain).otherwise(swapped).alias("columns"),
    )
    tuple_text = F.array(F.col("event_id").cast("string"), F.col("event_type"), F.col("value").cast("string"))
    changes = t.log.where("op <> 'create'").select(
        F.col("k").alias("relation_id"), F.col("event_id").alias("lsn_num"), tuple_text.alias("tuple")
    )
    joined = asof.asof_join(changes, versions, "relation_id", "lsn_num", ["version", "columns"], SEGMENT)
    named = asof.name_values(F.col("columns"), F.col("tuple"))
    typed = asof.decode_named(F.col("named"), RELATION)
    return joined.withColumn("named", named).select(
        "relation_id", "lsn_num", "version", *[c.alias(n) for n, c in typed.items()]
    )


@query(
    "a15_relation_decode",
    f"""WITH {LOG} SELECT c.k AS relation_id, c.event_id AS lsn_num, r.event_id AS version,
      CASE WHEN r.event_id IS NULL THEN NULL WHEN r.event_id % 2 = 0 THEN c.event_id ELSE 0 END AS id,
      CASE WHEN r.event_id IS NULL THEN NULL WHEN r.event_id % 2 = 0 THEN c.event_type ELSE CAST(c.event_id AS VARCHAR) END AS kind,
      CASE WHEN r.event_id % 2 = 0 THEN c.value END AS amount
    FROM (SELECT * FROM chg WHERE op <> 'create') c
    ASOF LEFT JOIN (SELECT * FROM chg WHERE op = 'create') r ON c.k = r.k AND c.event_id >= r.event_id""",
)
def relation_decode(t: Tables) -> DataFrame:
    return relation_decode_plan(t)


@query(
    "a16_document_actions",
    f"""WITH {LOG} SELECT event_id, CASE WHEN event_type = 'view' THEN 'skip' WHEN op = 'delete' THEN 'delete' ELSE 'upsert' END AS action,
    CAST(k AS VARCHAR) AS doc_id, NULL::VARCHAR AS error FROM chg""",
)
def document_actions(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "truncate").otherwise(F.col("op"))
    rows = merge.document_actions(t.log.withColumn(OP, op), "k")
    return rows.select("event_id", "action", "doc_id", "error")


@query(
    "a17_snapshot_merge",
    f"""WITH {DELIVERIES}, {SNAPSHOT},
    last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k, value, props FROM snap WHERE k NOT IN (SELECT k FROM last)
    UNION ALL SELECT k, value, props FROM last WHERE op <> 'delete'""",
)
def snapshot_merge(t: Tables) -> DataFrame:
    """Last change per key onto the snapshot.

    A change that was delivered twice needs no pass of its own: both copies have one position.
    """
    changes = t.deliveries.select("k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN))
    return merge.fan_in(t.snapshot, changes, ["k"], [LSN])


@query(
    "a17_merge_unchanged",
    f"""WITH {LOG}, {SNAPSHOT},
    last AS (SELECT k, arg_max(op, event_id) AS op, arg_max(value, event_id) AS value,
        arg_max(props, event_id) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS props FROM chg GROUP BY k)
    SELECT * FROM snap WHERE k NOT IN (SELECT k FROM last)
    UNION ALL SELECT last.k, last.value, coalesce(last.props, snap.props) FROM last LEFT JOIN snap ON last.k = snap.k
    WHERE op <> 'delete'""",
)
def merge_unchanged(t: Tables) -> DataFrame:
    """Updates that leave out ``props`` keep the newest known text."""
    left_out = F.when(F.col("op") == "update", F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))
    changes = t.log.select(
        "k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN), left_out.alias(UNCHANGED)
    )
    latest = merge.fold_unchanged(changes, ["k"], LSN, ["value", "props"])
    return merge.merge_snapshot(t.snapshot, merge.fill_unchanged(latest, t.snapshot, ["k"]), ["k"])


@query("a18_bulk_import", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def bulk_import(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "import")
    tables.import_documents(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return tables.scan_table(t.spark, path)


@query(
    "a19_publish_versions",
    f"""WITH {LOG}, {SNAPSHOT},
    last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k, value, props FROM snap WHERE k NOT IN (SELECT k FROM last)
    UNION ALL SELECT k, value, props FROM last WHERE op <> 'delete'""",
)
def publish_versions(t: Tables) -> DataFrame:
    """Base version, two batches of changes, a compaction between them, then a view swap."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "items"), ["k"], t.snapshot.schema)
    table.write_base(t.snapshot)
    changes = t.log.select("k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN))
    table.write_batch(changes.where(F.col(LSN) < 400), 1)
    table.compact()
    table.write_batch(changes.where(F.col(LSN) >= 400), 2)
    return table.publish("items")


@query(
    "a19_shared_version",
    f"""WITH {LOG}, {SNAPSHOT},
    last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k, value, props FROM snap WHERE k NOT IN (SELECT k FROM last)
    UNION ALL SELECT k, value, props FROM last WHERE op <> 'delete'""",
)
def shared_version(t: Tables) -> DataFrame:
    """Two published versions; another session reads the second."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "items"), ["k"], t.snapshot.schema)
    table.write_base(t.snapshot)
    changes = t.log.select("k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN))
    view = "published_items"
    for batch, part in enumerate(("event_id < 400", "event_id >= 400"), 1):
        table.write_batch(changes.where(part.replace("event_id", LSN)), batch)
        table.publish_version(view)
    return t.spark.newSession().table(view)


def numeric_code_task(name: str = "codes") -> SyncTask:
    return SyncTask(name, "public.items", "items", ("event_id",), transform=Transforms(fields=(Convert("code", "number"),)))


def coded_events(t: Tables) -> DataFrame:
    """Change rows whose text ``code`` is a number, except on errors."""
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return t.change_rows.withColumn("code", text).drop("props")


@query(
    "a23_dead_letter_write",
    """SELECT 'codes' AS task_id, event_id, event_type, '''' || props || ''' is no number' AS error,
    CAST(1 AS INTEGER) AS retry_count, TIMESTAMP '2024-02-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS last_retry_at
    FROM events WHERE event_type = 'error'""",
)
def dead_letter_write(t: Tables) -> DataFrame:
    failed = run_task(coded_events(t), numeric_code_task()).rejected
    store = DeadLetterTable(t.spark, scratch_path(t.spark, "dead"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    store.store(deadletters.entries(failed, F.lit("codes"), at, retry_count=1, identity=F.col(LSN)))
    return store.read().select(
        "task_id",
        F.get_json_object("event", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("event", "$.event_type").alias("event_type"),
        "error",
        "retry_count",
        "created_at",
        "last_retry_at",
    )


def letters(t: Tables) -> DataFrame:
    """Error events as dead letters: one task per user, three kinds of error text."""
    number = F.get_json_object("props", "$.k").cast("int") % 3
    error = (
        F.when(number == 0, "Connection refused\nat host a")
        .when(number == 1, "'x' is no number")
        .otherwise("")
    )
    return t.events.where("event_type = 'error'").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("task_id"),
        F.col("props").alias("event"),
        error.alias("error"),
        F.lit(0).alias("retry_count"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_retry_at"),
    )


LETTERS = """letters AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'task_' || user_id AS task_id, props AS event,
    CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 WHEN 0 THEN 'Connection refused' || chr(10) || 'at host a'
      WHEN 1 THEN '''x'' is no number' ELSE '' END AS error,
    0 AS retry_count, ts AS created_at, NULL::TIMESTAMP AS last_retry_at FROM events WHERE event_type = 'error')"""


@query(
    "a24_dead_letter_reprocess",
    f"""WITH {LETTERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at, id) AS rn FROM letters)
    SELECT id, task_id, CASE WHEN task_id = 'task_3' AND rn <= 4 THEN 1 ELSE 0 END AS retry_count,
      CASE WHEN task_id = 'task_3' AND rn <= 4 THEN TIMESTAMP '2024-02-01 00:00:00' END AS last_retry_at,
      CASE WHEN task_id = 'task_3' AND rn <= 4 THEN 'retried' ELSE 'waiting' END AS state FROM ranked""",
)
def dead_letter_reprocess(t: Tables) -> DataFrame:
    store = DeadLetterTable(t.spark, scratch_path(t.spark, "dead"))
    store.store(letters(t))
    taken = store.take_for_retry("task_3", 4, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    both = taken.withColumn("state", F.lit("retried")).unionByName(store.read().withColumn("state", F.lit("waiting")))
    return both.select("id", "task_id", "retry_count", "last_retry_at", "state")


@query(
    "a25_dead_letter_edit",
    f"""WITH {LETTERS} SELECT id, task_id, CASE WHEN task_id = 'task_1' THEN 'edited' ELSE error END AS error FROM letters
    WHERE task_id <> 'task_2' AND NOT (task_id = 'task_3' AND error = '')""",
)
def dead_letter_edit(t: Tables) -> DataFrame:
    """Update one task's entries, remove some by key, clear a task."""
    store = DeadLetterTable(t.spark, scratch_path(t.spark, "dead"))
    store.store(letters(t))
    store.update(deadletters.by_task(store.read(), "task_1").withColumn("error", F.lit("edited")))
    store.remove(deadletters.by_task(store.read(), "task_3").where("error = ''"))
    store.clear_task("task_2")
    return store.read().select("id", "task_id", "error")


@query(
    "a26_dead_letter_retention",
    f"""WITH {LETTERS} SELECT id, task_id, created_at FROM letters WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00'
    ORDER BY created_at DESC, id DESC LIMIT 700""",
)
def dead_letter_retention(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return deadletters.retained(letters(t), 700, now, hours=20 * 24).select("id", "task_id", "created_at")


@query(
    "a27_progress_table",
    """WITH stored AS (SELECT user_id AS task_id, event_id AS position, ts AS created_at FROM events WHERE event_type <> 'signup'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    pending AS (SELECT user_id AS task_id, event_id AS position, ts AS created_at FROM events WHERE event_type = 'signup' AND value > 100
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT *, true AS is_pending FROM pending
    UNION ALL SELECT *, false FROM stored WHERE task_id NOT IN (SELECT task_id FROM pending)""",
)
def progress_table(t: Tables) -> DataFrame:
    """Progress log kept as a table, listed together with rows not yet written."""
    rows = t.events.select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("position"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("kind"),
        "value",
    )
    wanted = ["task_id", "position", "created_at"]
    stored = KeyedTable(t.spark, scratch_path(t.spark, "progress"), ["task_id"], rows.select(*wanted).schema)
    log = rows.where("kind <> 'signup'").select(*wanted, F.lit("update").alias(OP), F.col("position").alias(LSN))
    stored.write_batch(log, 1)
    waiting = progress.latest(rows.where("kind = 'signup' AND value > 100").select(*wanted), tiebreak="position")
    return progress.overlay(
        waiting.withColumn("is_pending", F.lit(True)), stored.current().withColumn("is_pending", F.lit(False))
    )


@query(
    "a12_deep_objects",
    """SELECT event_id, 0 AS pos, repeat('{"a":', 20) || event_id || repeat('}', 20) AS item FROM events
    UNION ALL SELECT event_id, 1, '{"t":"' || event_type || '"}' FROM events""",
)
def deep_objects(t: Tables) -> DataFrame:
    """Objects nested 20 deep in arrays that break off."""
    deep = F.concat(F.repeat(F.lit('{"a":'), 20), F.col("event_id").cast("string"), F.repeat(F.lit("}"), 20))
    raw = F.concat(F.lit("["), deep, F.lit(', {"t": "'), F.col("event_type"), F.lit('"}, {"open": {'))
    return documents.explode_array(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "pos", "item")


@query(
    "a12_skipped_items",
    """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 1 ELSE 3 END::INT AS skipped,
      CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS kept FROM events""",
)
def skipped_items(t: Tables) -> DataFrame:
    """Items that are no objects, objects of a broken array that do not parse, and texts that are no arrays."""
    number = F.col("event_id").cast("string")
    mixed = F.concat(F.lit('[{"id": '), number, F.lit('}, '), number, F.lit(', "text", [{"inner": 1}], {"type": "'), F.col("event_type"), F.lit('"}]'))
    broken = F.concat(F.lit('[{"id": '), number, F.lit('}, {"bad": }, {"open": {'))
    raw = F.when(F.col("event_type") == "view", number).when(F.col("event_type") == "error", broken).otherwise(mixed)
    rows = t.events.select("event_id", raw.alias("raw"))
    kept = documents.explode_array(rows, "raw").groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"))
    counted = rows.select("event_id", documents.skipped_items(F.col("raw")).alias("skipped"))
    return counted.join(kept, "event_id", "left").select("event_id", "skipped", F.coalesce("kept", F.lit(0)).cast("int").alias("kept"))


TIED = """tied AS (SELECT event_id AS id, user_id % 3 AS task_id, date_trunc('day', ts) AS created_at FROM events)"""


def tied_rows(t: Tables) -> DataFrame:
    """Events as entries whose times repeat: one time per day."""
    at = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("task_id"), at.alias("created_at"))


@query(
    "a26_retention_of_ties",
    f"WITH {TIED} SELECT * FROM tied ORDER BY created_at DESC, id DESC LIMIT 1234",
)
def retention_of_ties(t: Tables) -> DataFrame:
    return deadletters.retained(tied_rows(t), 1234, F.lit("2030-01-01").cast("timestamp_ntz"))


@query(
    "a24_reprocess_failures",
    f"""WITH {LETTERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at, id) AS rn FROM letters)
    SELECT id, task_id, CASE WHEN task_id = 'task_3' AND rn <= 6 THEN 1 ELSE 0 END AS retry_count FROM ranked
    WHERE NOT (task_id = 'task_3' AND rn <= 6 AND error <> '')""",
)
def reprocess_failures(t: Tables) -> DataFrame:
    """Six entries are sent again; those without an error text fail again and stay, counted as retried."""
    store = DeadLetterTable(t.spark, scratch_path(t.spark, "dead"))
    store.store(letters(t))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    store.take_for_retry("task_3", 6, at, lambda rows: rows.where("error = ''"))
    return store.read().select("id", "task_id", "retry_count")
