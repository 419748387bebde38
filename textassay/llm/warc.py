"""WARC: a content-addressed archive. Payloads once by digest, record headers apart, records by joins."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.operators.joins import hot_keys, lookup_join
from textassay.session import materialise, scratch_path

FILE_BYTES = 32 << 20  # bytes of records, about, in one file
BATCH_BYTES = 8 << 20  # payload bytes a reader holds before it passes them on

# Fixed values of the WARC format and of its base 32 alphabet.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE_32, DIGITS_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _empty() -> Column:
    return F.lit("").cast("binary")


def base32(digest_hex: Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hex: 15 hex digits are 12 digits to the base 32."""
    groups = [(1, 15, 12), (16, 15, 12), (31, 10, 8)]
    return F.concat(
        *[
            F.translate(
                F.lpad(F.conv(F.substring(digest_hex, at, n), 16, 32), m, "0"), DIGITS_32, BASE_32
            )
            for at, n, m in groups
        ]
    )


def _record_id(*parts: Column) -> Column:
    """A URN made from the parts, the same whenever the job is run."""
    texts = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws("\n", *texts), 256)
    dashed = r"^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$"
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(digest, dashed, "$1-$2-5$3-8$4-$5"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. A value never ends its line early."""
    one_line = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), one_line, F.lit("\r\n")), F.lit(""))


@dataclass(frozen=True)
class Archive:
    """``records (page_id, record_id, record_type, refers_to, payload_bytes, digest, header)`` and
    ``payloads (digest, payload)``, each payload once."""

    records: DataFrame
    payloads: DataFrame


def archive(
    pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html",
    min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """The content-addressed archive of ``pages``: one record per row.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest key (null
    keys last, then the smallest URL) is the ``response``, the others ``revisit`` it; all smaller payloads
    are responses. A null body is an empty payload. Rows alike in all three columns are one response
    and its revisits, or revisits all. A null URL or key gives no such header line; line breaks in a URL are
    escaped. Other columns are ignored; an empty table gives an empty archive.

    A payload is addressed by its SHA-256. That equal digests mean equal payloads is verified by their
    SHA-1 and length; a collision stops the job. Copies are combined before the shuffle and only
    digests, not payloads, decide who revisits whom: no task meets all copies of a page.
    """
    payload = F.coalesce(F.col(body).cast("string").cast("binary"), _empty())
    wide = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    wide = wide.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    facts = wide.select(
        "page_id", "url", "digest", F.unhex(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    facts = facts.groupBy(*facts.columns).agg(F.count("*").alias("_copies"))
    facts = materialise(facts, "page_digests")

    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"))
    same = (F.min("sha1") == F.max("sha1")) & (F.min("payload_bytes") == F.max("payload_bytes"))
    shared = (
        facts.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min(order).alias("_first"), F.sum("_copies").alias("_n"), same.alias("_same"))
        .where((F.col("_n") > 1) | ~F.col("_same"))
    )
    verified = F.when(F.col("_same"), F.col("_n")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    shared = materialise(shared.select("digest", "_first", verified.alias("_n")), "shared_digests")
    joined = lookup_join(facts, shared, "digest", "page_id", "left", hot_keys(shared, "digest", "_n"))

    sha1_hex = F.lower(F.hex("sha1"))
    first = F.coalesce(F.col("_first") == order, F.lit(True))
    numbered = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    is_response = F.col("_n").isNull() | (first & (F.col("_copy") == 1))
    first_id = _record_id(F.col("_first.page_id"), F.col("_first.url"), F.hex("digest"), F.lit(1))
    numbered = numbered.select(
        "page_id",
        "url",
        "digest",
        "payload_bytes",
        sha1_hex.alias("sha1"),
        _record_id(F.col("page_id"), F.col("url"), F.hex("digest"), F.col("_copy")).alias("record_id"),
        F.when(is_response, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_response, first_id).alias("refers_to"),
        F.when(~is_response, F.col("_first.url")).alias("_refers_url"),
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _field("Content-Length", F.col("payload_bytes")),
        F.lit("\r\n"),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", bracketed(F.col("record_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _field("WARC-Refers-To", bracketed(F.col("refers_to"))),
        _field("WARC-Refers-To-Target-URI", F.col("_refers_url")),
        _field("WARC-Refers-To-Date", F.when(revisit, date)),
        _field("X-Page-Id", F.col("page_id")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
        F.lit("\r\n"),
        http,
    )
    records = numbered.select(
        "page_id", "record_id", "record_type", "refers_to", "payload_bytes", "digest", header.alias("header")
    )
    # dropping repeats keeps one payload per digest in each task before anything is shuffled
    once = wide.select("digest", "payload").dropDuplicates(["digest"])
    return Archive(_stored(records, "record_headers"), _stored(once, "payloads"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reconstruct(stored: Archive, revisits: bool = False) -> DataFrame:
    """The records' columns and ``payload``, the stored bytes, checked against their digest.

    Revisits have no bytes of their own; with ``revisits`` they get those of the page they revisit.
    A payload that is not what its digest says stops the job.
    """
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = stored.payloads.withColumn(
        "payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")))
    )
    own = stored.records.where("record_type = 'response'")
    if not revisits:
        return own.join(payloads, "digest").unionByName(
            stored.records.where("record_type <> 'response'").withColumn("payload", F.lit(None).cast("binary"))
        )
    counts = stored.records.groupBy("digest").agg(F.count("*").alias("n"))
    hot = hot_keys(materialise(counts, "digest_counts"), "digest", "n")
    if hot is None:
        return stored.records.join(payloads, "digest")
    return lookup_join(stored.records, payloads, "digest", "record_id", "inner", hot)


def write_warc(stored: Archive, path: str) -> None:
    """The archive as WARC files (gzip) in ``path``: header, payload, two line ends for each record."""
    found = stored.records.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("header") + F.col("payload_bytes")).alias("bytes")
    ).first()
    per_file = max(1, FILE_BYTES * (found["n"] or 1) // max(1, found["bytes"] or 1))
    record = F.concat(F.col("header").cast("binary"), F.coalesce("payload", _empty())).cast("string")
    (
        reconstruct(stored)
        .select(record.alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``(fields, header, payload)`` of each record of an open WARC file, by its stated lengths.

    The header ends before the payload: it includes the HTTP header of a response or revisit.
    """
    while True:
        head = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        if not head:
            if line == b"":
                return
            continue  # the line ends behind a record
        if not head[0].startswith(b"WARC/") or line == b"":
            raise ValueError("not a WARC record")
        fields = {}
        for row in head[1:]:
            name, _, value = row.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        cut = block.find(b"\r\n\r\n") + 4 if "application/http" in fields.get("content-type", "") else 0
        yield fields, b"".join(head) + b"\r\n" + block[:cut], block[cut:]


RECORD_COLUMNS = (
    "page_id bigint, record_id string, record_type string, refers_to string, target_uri string, "
    "payload_digest string, header binary, payload binary, payload_bytes bigint, payload_sha1 string"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the WARC files (plain or gzip) in ``path``: what the file holds.

    ``payload_bytes`` and ``payload_sha1`` are measured on the bytes read (null for revisits). Without
    ``payloads`` the bytes are measured but not returned. A task reads whole files, a record at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
             ("header", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_sha1", pa.string())]
        )
        rows, held = [], 0
        for batch in batches:
            for value in batch.column("content"):
                data = value.as_buffer()
                stream = io.BytesIO(data)
                zipped = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                stream = gzip.GzipFile(fileobj=stream) if zipped else stream
                for fields, header, payload in parse_records(stream):
                    own = fields["warc-type"] != "revisit"
                    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    page = fields.get("x-page-id")
                    rows.append(
                        {
                            "page_id": int(page) if page and re.fullmatch(r"-?\d+", page) else None,
                            "record_id": fields["warc-record-id"].strip("<>"),
                            "record_type": fields["warc-type"],
                            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
                            "target_uri": fields.get("warc-target-uri"),
                            "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None,
                            "header": header,
                            "payload": payload if own and payloads else None,
                            "payload_bytes": len(payload) if own else None,
                            "payload_sha1": sha1 if own else None,
                        }
                    )
                    held += len(header) + (len(payload) if payloads else 0)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD_COLUMNS)


def resolve(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the records read.

    A revisit gets length and digest of the response it names, and that page's id as ``refers_to``; it
    must state the digest of that response. A response whose bytes are not what its header
    states, or a revisit of nothing, stops the job.
    """
    records = records.drop("header", "payload")
    stated = F.col("payload_digest")
    damaged = F.raise_error(F.lit("a record's payload is not what its header states"))
    responses = records.where("record_type = 'response'").withColumn(
        "payload_digest", F.when(stated == F.col("payload_sha1"), stated).otherwise(damaged)
    )
    visited = responses.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
    )
    revisits = records.where("record_type = 'revisit'")
    # only responses that are revisited are looked up, so the table is as long as there are groups of copies
    counts = materialise(revisits.groupBy("refers_to").agg(F.count("*").alias("n")), "revisited")
    table = materialise(visited.join(counts, "refers_to", "left_semi"), "revisited_pages")
    found = lookup_join(revisits, table, "refers_to", "record_id", "left", hot_keys(counts, "refers_to", "n"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns[:4], F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select(
            "page_id", F.col("_bytes").alias("payload_bytes"),
            F.when(F.col("_digest") == stated, stated).otherwise(damaged).alias("payload_digest"),
            "record_type", F.col("_page").alias("refers_to"),
        )
    )
