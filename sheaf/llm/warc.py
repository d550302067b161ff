"""WARC archives: one gzip member per record, read back by byte ranges.

Writing: of the pages with equal payloads the one with the largest id is stored
in full (``response``), the others refer to it (``revisit``).

Reading: files are cut into byte ranges without regard to records. A task looks
for the gzip magic in its range, decodes the start of each candidate to see
whether it is a record, and owns the records that start inside; it reads on
past its end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.files import list_files, opened, rows_of, write_records

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of one range.
SPLIT = 8 << 20
#: Rows that one payload's copies are dealt over once they are more than a thousandth of all rows.
SALTS = 256
#: Bytes given to the decoder at once.
FED = 1 << 16

RECORD = (
    "page_id string, target_uri string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to string, payload binary"
)


def with_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``pages`` with ``_digest`` (hex SHA-1 of the payload), ``_first`` (the key stored in full), ``_stored``
    and ``_copy``, which numbers rows alike in key and payload from 1.

    Copies of one payload may be a third of all rows. Payloads with more than a
    thousandth of the rows, fewer than a thousand by that rule, are broadcast and
    their rows salted by key; the rest meet by digest.
    """
    digest = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    hashed = pages.withColumn("_digest", digest)
    groups = hashed.groupBy("_digest").agg(F.max(key).alias("_first"), F.count("*").alias("_n"))
    hot_rows = F.lit(pages.count() / 1000)
    hot = groups.where(F.col("_n") > hot_rows).select(F.col("_digest").alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = hashed.join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left").withColumn("_salt", salt)
    salts = F.when(F.col("_n") > hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    first = groups.select(F.col("_digest").alias("_d"), "_first", F.explode(salts).alias("_s"))
    joined = salted.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")))
    # rows alike in key and payload: one of them is stored
    alike = Window.partitionBy("_digest", "_salt", key).orderBy(F.lit(0))
    numbered = joined.withColumn("_copy", F.row_number().over(alike))
    return numbered.withColumn(
        "_stored", F.col(key).eqNullSafe(F.col("_first")) & (F.col("_copy") == 1)
    ).drop("_hot", "_salt", "_d", "_s")


def member(record: bytes) -> bytes:
    """The record as gzip, without the final zero byte that the sink adds.

    A gzip member ends in the top byte of its length: 0 below 16 MB. Longer
    records are followed by an empty member, which ends in 0 too.
    """
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out[:-1]


def record_id(key: str, digest: str, copy: int) -> str:
    """Follows from what the record is, so a revisit can name its response and reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}/{copy}')}>"


def record_bytes(
    key: str, url: str | None, payload: bytes | None, size: int, digest: str, first: str, copy: int, date: str
) -> bytes:
    """A response with its payload, or a revisit of ``first`` where the payload is None; ``size`` is the payload's.

    ``copy`` tells rows alike in key and payload apart. Of them the response is the first.
    """
    stored = payload is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if stored else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {key}",
    ]
    if not stored:
        lines += [
            f"WARC-Refers-To: {record_id(first, digest, 1)}",
            f"WARC-Profile: {PROFILE}",
            f"X-Refers-To-Page-ID: {first}",
        ]
    lines += [f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record for each row of ``pages`` (page_id, url, html) below ``path``.

    A null html is an empty payload, a null url ``about:blank``, a null page_id
    ``null`` and smaller than any other. Control characters, blanks and
    characters above ASCII in a url are percent-encoded. Of rows alike in page_id
    and payload one is the response. An empty table makes an empty archive.
    Other columns are left out.
    """
    rows = with_revisits(pages.select("page_id", "url", "html"), "page_id", "html")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = rows.select(
        text("page_id").alias("key"),
        "url",
        # a revisit needs the payload's length only
        F.when(F.col("_stored"), F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("payload"),
        F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("size"),
        "_digest",
        text("_first").alias("first"),
        F.col("_copy").alias("copy"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["_digest"])).decode()
                fields = (row[c] for c in ("key", "url", "payload", "size"))
                records.append(member(record_bytes(*fields, digest, row["first"], row["copy"], date)))
            yield pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})

    write_records(rows.mapInArrow(pack, "record binary"), "record", path)


def _begins_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 7) == b"WARC/1."
    except zlib.error:
        return False


def parsed(record: bytes, with_payload: bool) -> dict:
    """One record's fields; a length or digest that does not fit its bytes is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of page {fields.get('X-Page-ID')} is cut or damaged")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (
        len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"payload of page {fields.get('X-Page-ID')} does not have its digest")
    return {
        "page_id": fields["X-Page-ID"],
        "target_uri": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": fields.get("X-Refers-To-Page-ID"),
        "payload": payload if with_payload and kind == "response" else None,
    }


def read_range(path: str, start: int, end: int, with_payload: bool) -> Iterator[dict]:
    """The records that begin at ``start`` or later and before ``end``."""
    with opened(path) as file:
        size = file.size()
        # 2 bytes more, for a magic number across the end
        data = file.read_at(min(end + 2, size) - start, start)
        at = data.find(MAGIC)
        while 0 <= at < end - start:
            if len(data) - at < FED and start + len(data) < size:
                data += file.read_at(min(1 << 20, size - start - len(data)), start + len(data))
            if not _begins_record(data[at : at + FED]):
                at = data.find(MAGIC, at + 1)
                continue
            unpack, parts, fed = zlib.decompressobj(31), [], at
            while not unpack.eof:
                if fed == len(data):
                    more = file.read_at(min(max(len(data), 1 << 20), size - start - len(data)), start + len(data))
                    if not more:
                        raise ValueError(f"{path} ends inside the record at byte {start + at}")
                    data += more
                parts.append(unpack.decompress(data[fed : fed + FED]))
                fed = min(fed + FED, len(data))
            yield parsed(b"".join(parts), with_payload)
            at = data.find(MAGIC, fed - len(unpack.unused_data))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """All records below ``path``, columns of ``RECORD``.

    Every record is found exactly once however files are cut. ``payload_bytes`` and
    ``payload_digest`` (base32) are those of the full payload for revisits too.
    """
    ranges = list_files(spark, path).select(
        "path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split))).alias("start")
    )
    ranges = ranges.withColumn("end", F.col("start") + F.lit(split)).repartition("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.string()),
                ("target_uri", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.string()),
                ("payload", pa.binary()),
            ]
        )
        for row in rows_of(batches):
            held, size = [], 0
            for record in read_range(row["path"], row["start"], row["end"], with_payload):
                held.append(record)
                size += len(record["payload"] or b"")
                if len(held) >= 1000 or size > split:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.mapInArrow(read, RECORD)
