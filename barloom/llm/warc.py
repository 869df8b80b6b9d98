"""WARC archives as chunked record tables.

A payload is never held whole by the operator: it is walked as views on the Arrow buffer of the table (making chunk rows)
or read from the compressed stream (reading) in chunks of CHUNK bytes. A record is rows of (record, chunk number), each
with the digest of the payload up to and with its chunk; the row that is `last` has the digest and length of all of it.
Archives are written from chunk rows, in order, and read back into chunk rows.

Archives lie in the shared folder. A task writes under a name of its attempt and renames at the end, so a task that runs
again after a lost executor puts the same file in the same place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import durable, fresh_dir, fresh_name, table

#: Bytes of a payload that one row holds.
CHUNK = 1 << 16
#: An archive is closed, and the task's next one begun, past this many compressed bytes.
ROLL = 256 << 20
#: Rows are handed on when they hold about this much.
FLUSH = 4 << 20
#: Rows of about 100 bytes that may be broadcast.
BROADCAST_ROWS = 100_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the URL namespace of RFC 4122

CHUNK_FIELDS = "chunk_no long, data binary, payload_bytes long, payload_digest string, sha256 string, last boolean"


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


class _Rows:
    """Gathers rows by column and gives record batches of a schema, each of about FLUSH bytes."""

    def __init__(self, schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int):
        self.rows.append(row)
        self.bytes += size + 200
        return self.bytes > FLUSH

    def take(self):
        import pyarrow as pa

        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _arrow_schema(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _chunks(view, size: int):
    """Chunks of bytes from `view`, at least one, which may be empty."""
    for at in range(0, max(len(view), 1), size):
        yield view[at : at + size]


def _view(scalar) -> memoryview:
    return memoryview(scalar.as_buffer() or b"") if scalar.is_valid else memoryview(b"")


def chunk_table(pages: DataFrame, with_data: bool = True, chunk: int = CHUNK, keep: tuple = ("page_id",)) -> DataFrame:
    """The `keep` columns and the rows of the payload: chunk_no, data, payload_bytes, payload_digest, sha256 (so far), last,
    whole_bytes, whole_digest (of all of the payload).

    The payload is html in UTF-8; null is an empty payload, and an empty payload is one empty chunk. A row's chunks follow
    each other; repeated rows of `pages` are records of their own. Without data, only the last row of each record is made,
    and its data is null. An empty table gives an empty result. `keep` is columns of `pages`; one named as a new column is
    replaced.
    """
    added = StructType.fromDDL(CHUNK_FIELDS + ", whole_bytes long, whole_digest string")
    kept = [c for c in keep if c.lower() not in {f.name for f in added}]
    html = fresh_name(pages, "payload_html")
    schema = StructType([*[pages.schema[c] for c in kept], *added])

    def run(batches):
        rows = _Rows(_arrow_schema(schema))
        for batch in batches:
            for i, text in enumerate(batch.column(html)):
                own = tuple(batch.column(c)[i].as_py() for c in kept)
                view, whole = _view(text), hashlib.sha1()
                for part in _chunks(view, CHUNK):
                    whole.update(part)
                sha1, sha256, done, said = hashlib.sha1(), hashlib.sha256(), 0, _base32(whole)
                for no, part in enumerate(_chunks(view, chunk)):
                    sha1.update(part)
                    sha256.update(part)
                    done += len(part)
                    last = done == len(view)
                    if (with_data or last) and rows.add((*own, no, bytes(part) if with_data else None, done, _base32(sha1), sha256.hexdigest(), last, len(view), said), len(part) * with_data):
                        yield rows.take()
        yield rows.take()

    return pages.select(*kept, F.col("html").alias(html)).mapInArrow(run, schema)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha256, refers_to) of the pages whose payload an earlier page_id has too; repeats are one row.

    Payloads are equal if length and SHA-256 are. Pages that share the smallest page_id of a payload are no revisits.
    Payloads of fewer than `least_bytes` are never revisits. A null page_id refers to the others, and none refers to it.
    """
    digests = durable(chunk_table(pages, with_data=False).select("page_id", "sha256", "payload_bytes"))
    first = digests.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha256").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    # Rows of three small columns: a payload that many pages share is a skewed join that Spark may split.
    rows = digests.join(first.filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "sha256")
    return rows.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha256", "refers_to").distinct()


@contextmanager
def _stream(path: str, mode: str):
    """A byte stream: a shared mount through open(), other stores through Arrow's file systems."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        with open(parts.path, mode) as f:
            yield f
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_output_stream(at) if "w" in mode else store.open_input_stream(at) as f:
            yield f


def _rename(old: str, new: str) -> None:
    import os

    parts = urlparse(old)
    if parts.scheme in ("", "file"):
        os.replace(parts.path, urlparse(new).path)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(old)
        store.move(at, fs.FileSystem.from_uri(new)[1])


def _make_dir(path: str) -> None:
    import os

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        os.makedirs(parts.path, exist_ok=True)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)


def record_urn(page_id) -> str:
    return f"<{uuid.uuid5(NAMESPACE, f'page/{page_id}').urn}>"


def _head(page_id, url, length: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or f"urn:page:{page_id}").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else page_id),
        ("X-Payload-Length", length),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else length))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def records(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of `pages` (page_id, url, html) with page_id, url, refers_to and revisit.

    A revisit is one row without data. What is known of revisits is broadcast if it is BROADCAST_ROWS rows or fewer; else
    pages are shuffled to it. Chunks are made after that, so a record's rows stay together and in order.
    """
    again = durable(revisits(pages, least_bytes)).select(F.col("page_id").alias("again_id"), F.col("sha256").alias("again_sha"), "refers_to", F.lit(True).alias("again"))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("own_sha"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("own_sha") == F.col("again_sha")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.coalesce("again", F.lit(False)).alias("revisit"))
    chunks = chunk_table(rows, chunk=chunk, keep=("page_id", "url", "refers_to", "revisit"))
    return chunks.filter("last OR NOT revisit").withColumn("data", F.when(~F.col("revisit"), F.col("data")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK, level: int = 3) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) and returns the manifest: path, n_records, n_bytes.

    Archives are written from chunk rows and hold one gzip member for each record. A chunk whose running digest does not
    belong to its bytes is an error. The manifest is a table of its own in `folder`. An empty table makes an empty manifest.
    Other columns of `pages` are not written.
    """
    spark = pages.sparkSession
    _make_dir(folder)
    names = ("page_id", "url", "refers_to", "revisit", "data", "payload_digest", "last", "whole_bytes", "whole_digest")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        stream = files = out = member = digest = None
        made, n, size, number = [], 0, 0, 0

        def close():
            nonlocal stream, n, size, number
            files.__exit__(None, None, None)
            final = f"{folder}/part-{task.partitionId():05d}-{number:04d}.warc.gz"
            _rename(stream, final)
            made.append((final, n, size))
            stream, n, size, number = None, 0, 0, number + 1

        for batch in batches:
            for page, url, to, revisit, data, running, last, length, said in zip(*[batch.column(c) for c in names], strict=True):
                if stream is None:
                    stream = f"{folder}/.{task.taskAttemptId()}-{number:04d}.tmp"
                    files = _stream(stream, "wb")
                    out = files.__enter__()
                if member is None:
                    member, digest = zlib.compressobj(level, wbits=31), hashlib.sha1()
                    size += out.write(member.compress(_head(page.as_py(), url.as_py(), length.as_py(), said.as_py(), to.as_py(), revisit.as_py(), date)))
                if not revisit.as_py():
                    part = _view(data)
                    digest.update(part)
                    if _base32(digest) != running.as_py():
                        raise ValueError(f"chunks of page {page.as_py()} are not whole or not in order")
                    size += out.write(member.compress(part))
                if last.as_py():
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, n = None, n + 1
                    if size > ROLL:
                        close()
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    chunks = records(pages, least_bytes, chunk).select(*names)
    chunks.mapInArrow(run, "path string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _fields(stream) -> dict[str, str] | None:
    """The next header's fields, names in lower case; None at the end. Empty lines before it are skipped."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    fields = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


RECORD_FIELDS = "archive string, record_no long, record_id string, record_type string, target_uri string, page_id long, refers_to long, " + CHUNK_FIELDS


def read_archives(spark: SparkSession, archives: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of every record of the archives named in column `path`; archive and record_no name the record.

    Chunks come from the decompressing stream as they are read. A record whose digest is not that of its header is an
    error. A revisit is one row without data; its length and digest are those that its header has of the payload. Without
    data only the last rows are made.
    """
    schema = StructType.fromDDL(RECORD_FIELDS)

    def run(batches):
        rows = _Rows(_arrow_schema(schema))
        for path in (p.as_py() for batch in batches for p in batch.column("path")):
            with _stream(path, "rb") as raw, gzip.GzipFile(fileobj=raw) as stream:
                count = -1
                while (head := _fields(stream)) is not None:
                    left = int(head["content-length"])
                    left -= sum(len(x) for x in iter(stream.readline, b"\r\n")) + 2 if left else 0
                    number = lambda name: int(head[name]) if head.get(name) else None  # noqa: B023, E731
                    count += 1
                    base = (path, count, head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"))
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "revisit":
                        if rows.add((*base, 0, None, number("x-payload-length"), said, None, True), 0):
                            yield rows.take()
                        continue
                    sha1, sha256, done, no, last = hashlib.sha1(), hashlib.sha256(), 0, 0, False
                    while not last:
                        part = stream.read(min(chunk, left)) if left else b""
                        if left and not part:
                            raise EOFError(f"{path}: a record ends early")
                        left -= len(part)
                        done += len(part)
                        sha1.update(part)
                        sha256.update(part)
                        last = not left
                        if last and _base32(sha1) != said:
                            raise ValueError(f"{path}: digest of {base[2]} differs from its header")
                        if (with_data or last) and rows.add((*base, no, part if with_data else None, done, _base32(sha1), sha256.hexdigest(), last), len(part) * with_data):
                            yield rows.take()
                        no += 1
        yield rows.take()

    return archives.select("path").mapInArrow(run, schema)


def put_together(chunks: DataFrame) -> DataFrame:
    """A row for each record of chunk rows: archive, record_no, record_id, page_id, record_type, refers_to, payload_bytes,
    payload_digest. A record whose chunks do not add up to the length of its last row is an error.

    Chunks of an archive lie in one task, so they are combined before the shuffle, of which no data is a part.
    """
    record = ["archive", "record_no", "record_id", "page_id", "record_type", "refers_to"]
    end = F.struct("chunk_no", "payload_bytes", "payload_digest")
    found = chunks.groupBy(*record).agg(F.max(end).alias("end"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("bytes"), F.count("*").alias("n"))
    whole = (F.col("record_type") == "revisit") | ((F.col("bytes") == F.col("end.payload_bytes")) & (F.col("n") == F.col("end.chunk_no") + 1))
    length = F.when(whole, F.col("end.payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("chunks are missing of "), F.col("record_id"))).cast("long"))
    return found.select(*record, length.alias("payload_bytes"), F.col("end.payload_digest").alias("payload_digest"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as chunk rows, archives, and chunk rows again; nulls, repeated rows and the like as in the functions above.
    page_id is a whole number or null: it is read from the archives' headers."""
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    archives = manifest.repartition(max(1, manifest.count()))
    return put_together(read_archives(spark, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a digest is read off its bits, five at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(generate_series(1, 40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(digest, i, 1)) - 1), 4, '0')), 'string_agg', '') AS bits FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""
