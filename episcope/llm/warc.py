"""WARC archives: one gzip member per record, written by Spark's writers and read back in sequence."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm.common import small_side
from episcope.session import durable, shared_folder

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Rows per archive file; a reader holds one file's compressed bytes.
FILE_ROWS = 2000
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed value of the format
READ_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
               "payload_digest string, payload binary, valid boolean")


def _header(value: str) -> str:
    """A header value on one line; what does not fit there is percent-encoded."""
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                   for c in value)


def _plain(value: str) -> str:
    if "%" not in value:
        return value
    parts = value.split("%")
    return (parts[0].encode() + b"".join(bytes.fromhex(p[:2]) + p[2:].encode() for p in parts[1:])).decode("utf-8", "surrogatepass")


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, size: int, digest: str, payload: bytes) -> bytes:
    """One WARC record as a gzip member. A revisit has no block; both digests and the length of the full payload are kept."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_header(record_id)}>", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {size}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_header(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(payload)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


#: An empty gzip member; it ends with a zero byte.
EMPTY = gzip.compress(b"", 6, mtime=0)


def _line(member: bytes) -> bytes:
    """The member without a closing zero byte, which the writer's line end supplies. Members of records below 16 MiB end
    with one, as the last byte of the length; behind others an empty member is put, which decompresses to nothing."""
    return member[:-1] if member.endswith(b"\0") else member + EMPTY[:-1]


def records_of(data: bytes):
    """Sequential reader: decompress member after member in chunks, frame records by their content length, verify both
    digests. Yields tuples of READ_SCHEMA. Truncated or malformed archives raise ValueError."""
    at, total, view = 0, len(data), memoryview(data)
    while at < total:
        inflate, out = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            if at >= total:
                raise ValueError("the archive ends within a member")
            piece = view[at:at + CHUNK]
            out += inflate.decompress(piece)
            at += len(piece)
        at -= len(inflate.unused_data)
        start = 0
        while start < len(out):
            end = out.find(b"\r\n\r\n", start)
            lines = bytes(out[start:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record where one should start")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
            length = int(fields["content-length"])
            block = bytes(out[end + 4:end + 4 + length])
            start = end + 4 + length + 4
            if len(block) < length or out[start - 4:start] != b"\r\n\r\n":
                raise ValueError("a record is shorter than its content length")
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].split(":", 1)[1]
            own = hashlib.sha1(block).hexdigest()
            valid = own == fields["warc-block-digest"].split(":", 1)[1] and (kind == "revisit" or own == digest)
            uri, refers = fields.get("warc-target-uri"), fields.get("warc-refers-to")
            yield (_plain(fields["warc-record-id"][1:-1]), kind, None if uri is None else _plain(uri),
                   None if refers is None else _plain(refers[1:-1]), int(fields["x-payload-length"]), digest,
                   None if kind == "revisit" else block, valid)


def write_archives(df: DataFrame, folder: str, record_id: Column, uri: Column, payload: Column, order: Column) -> None:
    """Write a record per row. Of records with equal payloads of at least 1000 bytes the one with the largest ``order``
    is stored as response, the others as revisits of it; smaller ones are all responses, and so are rows that share the
    largest order. Null payloads are empty, null addresses left out. Rows with a null order never own a payload unless all
    rows with it have none; those are then all responses.

    The archive goes through Spark's own writer, so failed and repeated tasks leave nothing behind. Gzip members are
    binary: each is written as a line whose end is the member's last byte.
    """
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = df.select(record_id.cast("string").alias("id"), uri.alias("uri"), body.alias("body"), order.alias("o"))
    rows = rows.select("*", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("size"))
    # The owner of a payload, for payloads that occur more than once; partial maxima come before the shuffle.
    owners = (rows.where(F.col("size") >= REVISIT_BYTES).select("digest", "o", "id").groupBy("digest")
              .agg(F.max("o").alias("own_o"), F.max(F.when(F.col("o").isNotNull(), F.struct("o", "id")))["id"].alias("own_id"),
                   F.count(F.lit(1)).alias("n")).where("n > 1 and own_o is not null").drop("n"))
    told = rows.join(small_side(durable(owners)), "digest", "left").withColumn(
        "again", F.col("own_o").isNotNull() & ~F.col("o").eqNullSafe(F.col("own_o")))
    told = told.select("id", "uri", "digest", "size", "again", F.when(F.col("again"), F.col("own_id")).alias("refers"),
                       F.when(~F.col("again"), F.col("body")).alias("body"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind = "revisit" if r["again"] else "response"
                out.append(_line(record(r["id"] or "", kind, r["uri"], r["refers"], r["size"], r["digest"], r["body"] or b"")))
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = told.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_ROWS).option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder, in the columns of READ_SCHEMA; ``valid`` says whether the digests hold."""
    def run(batches):
        names = [x.rsplit(" ", 1)[0] for x in READ_SCHEMA.split(", ")]
        schema = pa.schema(list(zip(names, [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.bool_()])))
        for batch in batches:
            for i in range(batch.num_rows):
                out, held = [], 0
                for row in records_of(batch.column(0)[i].as_py()):
                    out.append(row)
                    held += len(row[6] or b"")
                    if held > 1 << 24 or len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # A file is a row of its own; batches of a few files keep little in memory.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive the pages in the shared folder, read the archives back and return a row per record: page id, bytes and
    SHA-1 of the full payload, record type and the page a revisit refers to. Invalid records raise."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    key = F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")))
    write_archives(pages, folder, key, F.col(url), F.encode(F.col(html), "UTF-8"), F.col(page_id))
    got = read_archives(pages.sparkSession, folder)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as long)")
    fine = F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("bad digest: "), "record_id")))
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", fine.alias("record_type"),
                      number("refers_to").alias("refers_to"))
