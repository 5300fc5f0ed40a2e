"""WARC archives of web pages: written with an index, read back through it.

Writing: pages are matched with the page of largest id among those with an equal payload; that page's
record is a response, the others are revisits without the payload. Each task writes an archive of its own,
a gzip member per record, under a name used once, and returns an index row per record: archive, offset,
length, URL, digest. The index is a table; what it doesn't list, such as the file of a failed attempt,
isn't part of the result.

Reading: index rows (all, or a selection) are cut by archive and span, sorted by offset within a span,
and records not further apart than `gap` bytes are read with one request.

Edge cases: null html is an empty payload, a null URL gives a record without target URI. Payloads of fewer
than `min_bytes` bytes are always responses. A page with a null id is a revisit if an equal payload has an
id; if none has, all are responses. Rows that repeat both the largest id and the payload are all responses.
Control characters and non-ASCII bytes in URLs are percent-encoded in the record and kept in the index.
Empty tables give empty indexes; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shared_folder, type_of

_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. refers_to: the page whose record holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers, payload."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_originals(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """page, url, payload, refers_to (null for a response)."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # a table of payloads that repeat: if it is small, or a payload hot, the payloads themselves need not be dealt by it
    first = rows.groupBy("sha", "bytes").agg(F.max("page").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "originals")
    refers = F.when((F.col("bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("page").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(first, ["sha", "bytes"], "left").select("page", "url", "payload", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write the archives into folder, which all executors must reach, and return the index (a table)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            rows = []
            for page, link, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                member = warc_record("" if page is None else str(page), link, payload, None if refers is None else str(refers), date)
                out.write(member)
                rows.append((name, offset, len(member), link, payload_digest(payload)))
                offset += len(member)
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["archive", "offset", "length", "url", "digest"])
        if out:
            out.close()

    return saved(with_originals(pages, page_id, url, html, min_bytes).mapInArrow(write, INDEX), "index")


def read_archives(index: DataFrame, folder: str, id_type: str = "long", *, payloads: bool = True, span: int = 8 << 20, gap: int = 64 << 10) -> DataFrame:
    """The records that index rows point to: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for a revisit).

    Fails if a payload doesn't have the digest of its record and its index row.
    """
    cell = Window.partitionBy("archive", "cell").orderBy("offset")
    rows = index.withColumn("cell", F.floor(F.col("offset") / span))
    apart = F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(cell) + gap
    rows = rows.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("apart").over(cell))
    requests = rows.groupBy("archive", "cell", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        F.array_sort(F.collect_list(F.struct("offset", "length", "url", "digest"))).alias("records"),
    )
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, start, end, records in zip(*(c for c in batch.columns)):
                with store.open_input_file(f"{path}/{archive}") as f:
                    data = f.read_at(end.as_py() - start.as_py(), start.as_py())
                out = []
                for r in records.as_py():
                    at = r["offset"] - start.as_py()
                    fields, http, payload = parse_record(data[at : at + r["length"]])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    own = digest if kind == "revisit" else payload_digest(payload)
                    if not own == digest == r["digest"]:
                        raise ValueError(f"{archive} at {r['offset']}: the payload's digest is {own}, not {digest}")
                    page, refers = (fields.get(h, "").removeprefix("<urn:page:").removesuffix(">") for h in ("WARC-Record-ID", "WARC-Refers-To"))
                    size = int(http["Content-Length"]) if kind == "revisit" else len(payload)
                    out.append((page or None, r["url"], size, own, kind, refers or None, payload if payloads and kind != "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    found = requests.select("archive", "start", "end", "records").mapInArrow(
        read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
    found = found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    return found if payloads else found.drop("payload")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder)
    found = read_archives(index, folder, type_of(pages, "page_id"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
o AS (SELECT h, max(page_id) original FROM p GROUP BY h),
j AS (SELECT page_id, p.h, original, sha1(p.h) s FROM p JOIN o USING (h)),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') digest FROM j)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes, digest payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> original THEN original END refers_to
FROM d
"""
