"""WARC: writing captures as request, response and metadata records, and assembling them again.

Every page becomes three records of WARC 1.1, linked by concurrent-to identifiers, in gzip archives
that Spark's text writer lays down in the shared folder. Archives are read back as whole files and
cut at their content lengths inside each task; the records are then joined through the identifiers
to one nested row per capture. Equal payloads of MIN_REVISIT bytes or more are stored once: the
smallest page_id is the response, the others are revisit records that refer to it.

Defined cases: a null html is an empty payload; a null page_id never is the smallest of its payload;
rows with equal smallest page_id are all responses; repeated rows repeat their records and give one
capture each; a null url has no target URI; line breaks in a url are percent-encoded in the header;
an empty table gives no archive record and an empty result. Extra columns are not archived.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import table
from lumenota.session import checkpointed, shared_folder

MIN_REVISIT = 100
#: Mean size of an archive before compression; whole archives are read by one task.
ARCHIVE_BYTES = 16 << 20
CRLF = "\r\n"

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to_id string, uri string, "
    "declared_digest string, page_id long, payload_bytes long, payload_digest string, "
    "payload binary"
)


def _record_id(kind: str, key: Column) -> Column:
    h = F.sha2(F.concat(F.lit(f"{kind} "), key), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _capture_key(page_id: Column, url: Column, digest: Column) -> Column:
    shown = F.coalesce(page_id.cast("string"), F.lit("-"))
    return F.concat_ws(" ", shown, digest, F.coalesce(F.concat(F.lit("u"), url), F.lit("-")))


def _record(kind: str, ids: dict[str, Column], block: Column, uri: Column) -> Column:
    """Header lines, an empty line and the block; a null identifier leaves its line out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in ids.items()]
    safe = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines.append(F.concat(F.lit("WARC-Target-URI: "), safe))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _first_of_payload(narrow: DataFrame) -> DataFrame:
    """(page_id, digest) of every revisit with the capture key of its response."""
    large = narrow.where(F.col("bytes") >= MIN_REVISIT)
    heads = large.where(F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("__digest"))
    heads = heads.agg(
        F.min(F.struct("page_id", "url")).alias("__head"), F.count(F.lit(1)).alias("__n")
    )
    again = large.join(heads, F.col("digest") == F.col("__digest"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("__head.page_id"))
    key = _capture_key(F.col("__head.page_id"), F.col("__head.url"), F.col("digest"))
    return again.where(later).select(
        F.col("page_id").alias("__page"), "__digest", _record_id("response", key).alias("__refers")
    ).distinct()


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as archives in ``folder``."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    narrow = checkpointed(
        pages.select("page_id", "url", "digest", F.octet_length("html").alias("bytes"))
    )
    size = narrow.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    mean = (size[1] or 0) // max(size[0], 1) + 600
    revisits = _first_of_payload(narrow)
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    joined = pages.join(revisits, same, "left")
    key = _capture_key(F.col("page_id"), F.col("url"), F.col("digest"))
    joined = joined.withColumn("__key", key)
    kind = F.when(F.col("__refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    main = F.when(
        F.col("__refers").isNull(), _record_id("response", F.col("__key"))
    ).otherwise(_record_id("revisit", F.col("__key")))
    joined = joined.withColumn("__main", main)
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    status = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}")
    about = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)
    )
    linked = {"WARC-Concurrent-To": F.col("__main")}
    uri = F.col("url")
    request = _record(
        "request",
        {"WARC-Record-ID": _record_id("request", F.col("__key"))} | linked,
        F.lit(f"GET / HTTP/1.1{CRLF * 2}"),
        uri,
    )
    about = _record(
        "metadata",
        {"WARC-Record-ID": _record_id("metadata", F.col("__key"))} | linked,
        about,
        uri,
    )
    own = {"WARC-Record-ID": F.col("__main"), "WARC-Payload-Digest": digest}
    full = _record("response", own, F.concat(status, F.col("html")), uri)
    again = _record("revisit", own | {"WARC-Refers-To": F.col("__refers")}, status, uri)
    response = F.when(kind == "response", full).otherwise(again)
    records = joined.select(F.explode(F.array(request, response, about)).alias("value"))
    (
        records.write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * max(1, ARCHIVE_BYTES // mean))
        .text(folder)
    )


def _records(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record of an archive, cut at the content lengths."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n") if end >= 0 else [b""]
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(b": ", 1) for line in lines[1:])
        begins = end + 4
        at = begins + int(headers[b"Content-Length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record ends early at byte {at}")
        yield headers, content[begins:at]
        at += 4


def _inflated(data: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``; payloads only where asked for."""
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[part.split()[1]]) for n, part in zip(names, RECORD.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in _records(_inflated(content.as_py())):
                    get = lambda k, h=headers: h[k].decode() if k in h else None
                    kind, page, body = get(b"WARC-Type"), None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        text = block.partition(b"page-id: ")[2].split(b"\r\n")[0]
                        page = int(text) if text else None
                    rows.append(
                        (kind, get(b"WARC-Record-ID"), get(b"WARC-Concurrent-To"),
                         get(b"WARC-Refers-To"), get(b"WARC-Target-URI"),
                         get(b"WARC-Payload-Digest"), page,
                         None if body is None else len(body),
                         None if body is None else sha256(body).hexdigest(),
                         body if payload else None)
                    )
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with its request and metadata.

    Requests and metadata are one row per concurrent-to identifier before they are joined, so that
    repeated captures stay one row each; a revisit takes size and page of the response it refers to.
    """
    side = lambda kind, *cs: (
        records.where(F.col("type") == kind)
        .select(F.col("concurrent_to").alias("__to"), F.struct("record_id", *cs).alias(kind))
        .dropDuplicates(["__to"])
    )
    main = records.where(F.col("type").isin("response", "revisit"))
    for kind, extra in (("request", ["uri"]), ("metadata", ["page_id"])):
        main = main.join(side(kind, *extra), F.col("record_id") == F.col("__to"), "left")
        main = main.drop("__to")
    capture = F.struct(
        "record_id", "uri", "declared_digest", "payload_bytes", "payload_digest", "payload"
    )
    main = main.select(
        "type", "refers_to_id", capture.alias("response"), "request", "metadata",
    )
    heads = (
        main.where(F.col("type") == "response")
        .select(
            F.col("response.record_id").alias("__id"),
            F.col("metadata.page_id").alias("refers_to"),
            F.col("response.payload_bytes").alias("__bytes"),
        )
        .dropDuplicates(["__id"])
    )
    # a response refers to nothing: its own id, which no head is looked up by, spreads those rows
    nothing = F.concat(F.lit("none "), F.col("response.record_id"))
    looked_up = F.coalesce(F.col("refers_to_id"), nothing)
    joined = main.join(heads, looked_up == F.col("__id"), "left")
    return joined.withColumn(
        "full_bytes", F.coalesce(F.col("response.payload_bytes"), F.col("__bytes"))
    ).drop("__id", "__bytes")


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived in the shared folder, read back and assembled."""
    folder = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    captures = assemble(checkpointed(read_records(spark, folder, payload=False)))
    declared = F.substring_index("response.declared_digest", ":", -1)
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", declared).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


OP8_SQL = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p
), f as (
  select *, case when payload_bytes >= 100
                 then min(page_id) over (partition by payload_digest) else page_id end as head
  from d
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when head = page_id then 'response' else 'revisit' end as record_type,
       case when head <> page_id then head end as refers_to
from f
"""
