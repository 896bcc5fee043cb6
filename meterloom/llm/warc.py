"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of a WARC file in the shared folder.  Of pages with equal
payloads the one with the smallest identifier is a response, the others revisit it.  Each task
writes files of its own under new names; the table of captures, committed by Spark, names what
counts, so what a lost or repeated task has left behind is never read.

Index: captures are sorted by URL key (host labels reversed) over all tasks and packed into
compressed blocks of lines.  The directory has one short prefix per block.  Blocks grow with the
number of captures so that the directory never has more than about ``DIRECTORY`` entries of
``PREFIX`` characters, which bounds its broadcast.

Reading: keys are bisected in the directory, then in the blocks they may stand in, and what is found
is read by byte range, in file order, and parsed; a response whose payload does not have the digest
in its header is an error.

A null page has an empty payload.  A null or malformed URL gets a key of its own form and is indexed
like any other.  Rows that share the smallest identifier of a payload are all responses; a null
identifier is larger than any, and payloads that only such rows have are responses; an empty table
gives empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import arrow, shared_dir, stored, utf8

ARCHIVE_BYTES, LINES, DIRECTORY, PREFIX, CHUNK = 1 << 30, 1_000, 250_000, 100, 8 << 20
DATE = "1970-01-01T00:00:00Z"

CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
CAPTURE_DDL = "key string, page_id long, file string, start long, length long"
PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
PAGE_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``; one line without tabs, whatever the input."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
        key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        key = f"){url}"
    return "".join(c if c.isprintable() else "?" for c in key)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A row of PAGE from the bytes of a record; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda urn: None if urn is None or "none" in urn else int(urn[len("<urn:page:"):-1])
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages under ``folder``; the stored table of captures."""
    def payloads(batches):
        for batch in batches:
            found = utf8(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array([digest_of(p) for p in found]), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "payload", "digest", "size"])

    def digests(batches):
        for batch in payloads(batches):
            yield batch.select(["page_id", "digest", "size"])

    def write(batches):
        store, top = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at > archive_bytes:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield arrow(rows, CAPTURE)
        if out:
            out.close()

    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    shared = given.mapInArrow(digests, "page_id long, digest string, size long").groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = stored(shared.where(f"n > 1 AND size >= {least_bytes} AND first IS NOT NULL").drop("n"))
    whole = given.mapInArrow(payloads, "page_id long, url string, payload binary, digest string, size long")
    decided = whole.join(shared, ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return stored(decided.mapInArrow(write, CAPTURE_DDL))


def build_index(captures: DataFrame, lines: int = LINES, directory: int = DIRECTORY) -> DataFrame:
    """The stored blocks ``block, prefix, data`` of the capture index; ``block`` ascends with the keys."""
    spark = captures.sparkSession
    most = max(lines, captures.count() // directory)

    def pack(batches):
        place, waiting, number = TaskContext.get().partitionId(), [], 0

        def block():
            nonlocal number
            number += 1
            data = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in row) for row in waiting[:most]).encode())
            return arrow([((place << 32) + number, waiting[0][0][:PREFIX], data)], schema)

        schema = pa.schema([("block", pa.int64()), ("prefix", pa.string()), ("data", pa.binary())])
        for batch in batches:
            waiting += zip(*(c.to_pylist() for c in batch.columns))
            while len(waiting) >= most:
                yield block()
                del waiting[:most]
        if waiting:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").cast("binary"), "page_id", "file", "start"]
    return stored(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "block long, prefix string, data binary"))


def look_up(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures of all URL keys of the frame ``key``."""
    entries = sorted(blocks.select("block", "prefix").collect())
    directory = blocks.sparkSession.sparkContext.broadcast(([p.encode() for _, p in entries], [b for b, _ in entries]))

    def find(batches):
        prefixes, numbers = directory.value
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                short = key[:PREFIX].encode()
                for k in range(max(0, bisect_left(prefixes, short) - 1), bisect_right(prefixes, short)):
                    rows.append((key, numbers[k]))
            yield arrow(rows, pa.schema([("key", pa.string()), ("block", pa.int64())]))

    def within(_, wanted, block):
        rows = []
        if block.num_rows:
            lines = [line.split("\t") for line in zlib.decompress(block.column("data")[0].as_py()).decode().split("\n")]
            known = [line[0].encode() for line in lines]
            for key in wanted.column("key").to_pylist():
                for k in range(bisect_left(known, key.encode()), bisect_right(known, key.encode())):
                    _, page_id, file, start, length = lines[k]
                    rows.append((key, int(page_id) if page_id else None, file, int(start), int(length)))
        return pa.Table.from_batches([arrow(rows, CAPTURE)])

    asked = keys.where("key IS NOT NULL").select("key").distinct().mapInArrow(find, "key string, block long")
    return asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(within, CAPTURE_DDL)


def read_captures(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records at the given places: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``."""
    def read(batches):
        store, top = fs.FileSystem.from_uri(folder)
        source, name = None, None
        for batch in batches:
            rows = []
            for file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    source, name = store.open_input_file(f"{top}/{file}"), file
                source.seek(start)
                row = parsed(gzip.decompress(source.read(length)))
                rows.append(row if payload else (*row[:-1], None))
            yield arrow(rows, PAGE)

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.select("file", "start", "length").repartition(parts, "file", F.expr(f"start div {CHUNK}")).sortWithinPartitions("file", "start")
    return dealt.mapInArrow(read, PAGE_DDL)


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url_col).cast("string")).mapInArrow(run, "key string")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_dir(spark)
    captures = write_archives(pages, folder)
    found = look_up(build_index(captures), url_keys(pages))
    return read_captures(found, folder, payload=False).drop("payload", "url")
