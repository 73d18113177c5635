"""Content-addressed WARC archive.

Payload bytes are stored once, under a strong digest (SHA-256) that is verified: rows are grouped by
digest and bytes together, so unequal bytes under one digest are noticed and kept apart by a variant
number. Record headers are stored separately, byte for byte. Records are rebuilt by joining the
two; ``write_files`` and ``read_files`` turn them into WARC files and back.

Of records with equal payloads one is a response; the others are revisit records, which carry the
headers and the digest but no payload bytes.
"""

from __future__ import annotations

import base64
import gzip
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftline.llm.common import stored
from driftline.session import scratch_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Crawl dates are no part of the input: one fixed date keeps reruns equal byte for byte.
DATE = "1970-01-01T00:00:00Z"
# Records of one WARC file; a file is read by one task.
FILE_RECORDS = 500


@F.pandas_udf(StringType())
def base32(hex_digest: pd.Series) -> pd.Series:
    """Upper-case base32 of hex digits, without a prefix."""
    return hex_digest.map(lambda h: None if h is None else base64.b32encode(bytes.fromhex(h)).decode("ascii"))


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def _header(response: Column) -> Column:
    """The record up to its payload."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    block = F.octet_length(http) + F.when(response, F.col("size")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("__id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("__url")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first")))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http).cast("binary")


def archive(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    digest: Callable[[Column], Column] = sha256,
) -> tuple[DataFrame, DataFrame]:
    """Writes the archive of ``pages`` and returns its two tables, ``headers`` and ``payloads``.

    ``payloads(digest, variant, body)`` has one row per distinct payload; ``headers(key, type,
    digest, variant, header)`` has one row per row of ``pages``, the exact bytes of the record up to
    its payload. Null payloads and urls are empty ones; line ends in urls are escaped. Of equal
    payloads of at least ``min_bytes`` bytes the smallest key is the response and other keys revisit
    it; smaller payloads are all responses. A null key responds only where there is no other, and
    rows that repeat the responding key all respond. An empty table gives an empty archive; other
    columns are ignored. ``digest`` can be weakened by a test.
    """
    spark = pages.sparkSession

    def rows(*more: Column) -> DataFrame:
        read = pages.select(
            F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary")).alias("body"), *more
        )
        return read.withColumn("digest", digest(F.col("body")))

    distinct = rows().groupBy("digest", "body").agg(F.min("__id").alias("first"))
    path = scratch_path(spark, "warc-payloads")
    distinct.write.option("compression", "zstd").parquet(path)
    bodies = spark.read.schema(distinct.schema).parquet(path)
    clashes = bodies.groupBy("digest").count().where("count > 1").select("digest")
    target = F.regexp_replace(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("__url")
    if clashes.isEmpty():
        payloads = bodies.withColumn("variant", F.lit(0))
        on = ["digest"]
    else:
        apart = bodies.join(clashes, "digest").withColumn("variant", F.row_number().over(W.partitionBy("digest").orderBy("body")) - 1)
        payloads = stored(
            bodies.join(clashes, "digest", "left_anti").withColumn("variant", F.lit(0)).unionByName(apart), "warc-variants"
        )
        on = ["digest", "body"]
    placed = rows(target).withColumns({"size": F.octet_length("body").cast("bigint"), "sha1": base32(F.sha1("body"))})
    placed = (placed if "body" in on else placed.drop("body")).join(payloads.select(*on, "first", "variant"), on)
    response = (F.col("size") < min_bytes) | F.col("__id").eqNullSafe(F.col("first"))
    headers = placed.select(
        F.col("__id").alias(key), F.when(response, "response").otherwise("revisit").alias("type"), "digest", "variant",
        _header(response).alias("header"),
    )
    return stored(headers, "warc-headers"), payloads.select("digest", "variant", "body")


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """``(record binary)``: every record of the archive as it was, without the two line ends that close it."""
    with_body = headers.where("type = 'response'").join(payloads, ["digest", "variant"])
    return with_body.select(F.concat("header", "body").alias("record")).unionByName(
        headers.where("type = 'revisit'").select(F.col("header").alias("record"))
    )


def parsed(read: DataFrame, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """What ``records`` say: key, ``url, record_type, refers_to, payload_bytes, payload_digest, body, intact``.

    Length and digest of a response are computed from its bytes, ``intact`` says whether its header
    agrees; a revisit has what its header states, and no body; :func:`verified` checks that.
    """

    def field(name: str, value: str = "(.*?)") -> Column:
        return F.regexp_extract("__head", rf"\r\n{name}: {value}\r\n", 1)

    head = F.substring_index(F.col("record").cast("string"), END, 2)
    rows = read.withColumn("__head", F.concat(head, F.lit(END)))
    rows = rows.withColumn("record_type", field("WARC-Type"))
    full = F.col("record_type") == "response"
    rows = rows.withColumn("body", F.when(full, F.expr("substring(record, octet_length(__head) + 1)")))
    stated = F.regexp_extract("__head", r"charset=utf-8\r\nContent-Length: ([0-9]+)\r\n", 1).cast("bigint")
    digest = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    rows = rows.withColumns({"__bytes": stated, "__digest": digest, "__size": F.octet_length("body").cast("bigint"), "__own": base32(F.sha1("body"))})
    return rows.select(
        F.expr(f"try_cast(regexp_extract(__head, 'WARC-Record-ID: <urn:page:(.*?)>', 1) as {key_type})").alias(key),
        field("WARC-Target-URI").alias("url"),
        "record_type",
        F.expr(f"try_cast(regexp_extract(__head, 'WARC-Refers-To: <urn:page:(.*?)>', 1) as {key_type})").alias("refers_to"),
        F.coalesce("__size", "__bytes").alias("payload_bytes"),
        F.coalesce("__own", "__digest").alias("payload_digest"),
        "body",
        F.when(full, (F.col("__size") == F.col("__bytes")) & (F.col("__own") == F.col("__digest"))).otherwise(True).alias("intact"),
    )


def verified(back: DataFrame, key: str = "page_id") -> DataFrame:
    """``back`` with ``intact`` false for revisits without an intact response of the key they refer to
    whose own bytes have the stated length and digest.

    What revisits state is made distinct first, so large groups of copies do not meet their response
    row by row. ``back`` is read several times.
    """
    stated = F.struct("refers_to", "payload_digest", "payload_bytes").alias("__as")
    own = F.struct(F.col(f"`{key}`").alias("refers_to"), "payload_digest", "payload_bytes").alias("__as")
    answered = back.where("record_type = 'response' AND intact").select(own).distinct()
    lost = back.where("record_type = 'revisit'").select(stated).distinct().join(answered, "__as", "left_anti")
    if lost.isEmpty():
        return back
    marked = back.withColumn("__as", stated).join(lost.withColumn("__lost", F.lit(True)), "__as", "left")
    bad = (F.col("record_type") == "revisit") & F.col("__lost").isNotNull()
    return marked.withColumn("intact", F.col("intact") & ~bad).select(*back.columns)


def write_files(rebuilt: DataFrame, path: str, per_file: int = FILE_RECORDS, compression: str = "none") -> None:
    """WARC files: every record followed by the two line ends that close it. Payloads are UTF-8.

    ``compression`` is ``none`` or ``gzip``.
    """
    lines = rebuilt.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(record binary)`` of the WARC files below ``path``, plain or gzip, cut by their Content-Length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                at, found = 0, []
                while at < len(data):
                    head = data.index(END.encode(), at)
                    sizes = [x for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    stop = head + len(END) + int(sizes[-1].split(b":")[1])
                    if data[stop : stop + len(END)] != END.encode():
                        raise ValueError(f"record at byte {at} does not end where its length says")
                    found.append(data[at:stop])
                    at = stop + len(END)
                yield pd.DataFrame({"record": found})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt{,.gz}").load(path).select("content")
    return files.mapInPandas(run, "record binary")
