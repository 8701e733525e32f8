"""WARC archives in the shared folder, and the chunked record table read back from them.

Writing: equal payloads are found by digest (pre-aggregated, then a sort-merge join that adaptive execution can split); each task writes one archive, every
record a gzip member of its own, to a temporary name that it renames when complete, so a retried task replaces its file. A payload goes through hash and compressor in slices.
Reading: archives are streamed; a record's payload comes as (record_id, chunk_no) rows of at most chunk_bytes, each with the SHA-1 of the payload
so far, so no reader holds a whole record. The last chunk's running digest is the payload's.

A response holds an HTTP header and the html; a revisit holds the HTTP header alone, whose Content-Length is the full payload's, and names the response it repeats.

Defined cases: null html is an empty payload; the largest page_id of equal payloads is the response (rows that repeat it are responses too); where all ids are null, so are all
responses; no rows make no archives and an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, stored

SLICE = 1 << 18
CHUNK_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def filesystem(path: str):
    """(file system, path in it) of a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(archive: str, number: int) -> str:
    """Unique for each record, also of repeated or missing page ids, and the same when a task runs again."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive} {number}')}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def slices(text: str) -> Iterator[bytes]:
    for at in range(0, len(text), SLICE):
        yield text[at : at + SLICE].encode("utf-8", "surrogatepass")


def write_record(out, own_id: str, page_id, url: str | None, html: str, response_of) -> int:
    """Append one gzip member; response_of: page_id of the response that this one repeats, or None. Returns payload bytes.

    A revisit names its response by the payload digest, as its profile has it, and by the page id; record ids depend on where a record lies.
    """
    digest, length = hashlib.sha1(), 0
    for part in slices(html):
        digest.update(part)
        length += len(part)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = response_of is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or 'urn:x-none').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(digest.digest())}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"Content-Length: {len(http) + (0 if revisit else length)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {response_of}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    out.write(squeeze.compress(("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http))
    if not revisit:
        for part in slices(html):
            out.write(squeeze.compress(part))
    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
    return length


def _write(batches, folder: str):
    from pyspark import TaskContext

    task = TaskContext.get()
    store, root = filesystem(folder)
    name = f"{root}/part-{task.partitionId():06d}.warc.gz"
    temporary = f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
    out, records = None, 0
    for batch in batches:
        columns = [batch.column(k) for k in range(4)]
        for k in range(batch.num_rows):
            if out is None:
                out = store.open_output_stream(temporary, compression=None)
            page_id, url, html, refers = (c[k].as_py() for c in columns)
            write_record(out, record_id(name, records), page_id, url, html, refers)
            records += 1
    if out is not None:
        out.close()
        store.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [records]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))


def write(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[str, DataFrame]:
    """(folder, manifest): archives of all pages; manifest has path and records of each archive."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    groups = keyed.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    refers = F.when(F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first_id"))
    placed = keyed.join(groups, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    folder = new_path(pages.sparkSession, "warc")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    return folder, stored(placed.mapInArrow(partial(_write, folder=folder), "path string, records long"), "warc-manifest")


class _Member:
    """Decompressed bytes of an archive, read piece by piece across its gzip members."""

    def __init__(self, source):
        self.source, self.buffer, self.raw, self.inflate = source, b"", b"", None

    def fill(self) -> bool:
        while True:
            if self.inflate is None or self.inflate.eof:
                self.raw = (self.inflate.unused_data if self.inflate else self.raw) or self.source.read(SLICE)
                if not self.raw:
                    return False
                self.inflate = zlib.decompressobj(31)
                more = self.inflate.decompress(self.raw, SLICE)
            elif self.inflate.unconsumed_tail:
                more = self.inflate.decompress(self.inflate.unconsumed_tail, SLICE)
            else:
                raw = self.source.read(SLICE)
                if not raw:
                    return False
                more = self.inflate.decompress(raw, SLICE)
            if more:
                self.buffer += more
                return True

    def head(self) -> list[str] | None:
        """Lines up to an empty one."""
        at = self.buffer.find(b"\r\n\r\n")
        while at < 0:
            if not self.fill():
                return None
            at = self.buffer.find(b"\r\n\r\n")
        lines, self.buffer = self.buffer[:at].decode("utf-8", "surrogatepass").split("\r\n"), self.buffer[at + 4 :]
        return lines

    def take(self, most: int) -> bytes:
        while not self.buffer:
            if not self.fill():
                raise ValueError("archive ends inside a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def read_archive(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of one archive. Empty payloads have one empty chunk."""
    reader = _Member(source)
    while (lines := reader.head()) is not None:
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        http = reader.head() or []
        fields = dict(x.split(": ", 1) for x in http[1:])
        size = int(head["Content-Length"]) - len("\r\n".join(http).encode()) - 4
        row = {
            "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "target_uri": head["WARC-Target-URI"], "page_id": int(head["X-Page-ID"]) if head["X-Page-ID"] else None,
            "refers_to": int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None, "stated_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "stated_bytes": int(fields["Content-Length"]),
        }
        running, chunk_no, left = hashlib.sha1(), 0, size
        while True:
            parts, room = [], min(left, chunk_bytes)
            while room:
                parts.append(reader.take(room))
                room -= len(parts[-1])
            data = b"".join(parts)
            left -= len(data)
            running.update(data)
            if not left and row["record_type"] == "response" and base32(running.digest()) != row["stated_digest"]:
                raise ValueError(f"payload of record {row['record_id']} differs from its digest")
            yield row | {"chunk_no": chunk_no, "data": data, "n_bytes": len(data), "digest_so_far": base32(running.digest()), "is_last": not left}
            chunk_no += 1
            if not left:
                break
        end = b""
        while len(end) < 4:
            end += reader.take(4 - len(end))
        if end != b"\r\n\r\n":
            raise ValueError(f"record {row['record_id']} doesn't end where it says")


CHUNKS = pa.schema([
    ("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("record_type", pa.string()),
    ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()),
])
CHUNKS_DDL = "record_id string, chunk_no long, data binary, n_bytes long, digest_so_far string, is_last boolean, record_type string, target_uri string, page_id long, refers_to long, stated_digest string, stated_bytes long"


def _read(batches, folder: str, chunk_bytes: int, with_data: bool):
    store, _ = filesystem(folder)
    held: list[dict] = []
    size = 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with store.open_input_stream(path, compression=None) as source:
                for row in read_archive(source, chunk_bytes):
                    size += len(row["data"]) if with_data else 0
                    held.append(row if with_data else row | {"data": None})
                    if len(held) >= 2000 or size >= 4 * chunk_bytes:
                        yield pa.RecordBatch.from_pylist(held, schema=CHUNKS)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=CHUNKS)


def read_chunks(folder: str, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest (column path)."""
    paths = manifest.select("path")
    files = max(1, min(paths.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return paths.repartition(files).mapInArrow(partial(_read, folder=folder, chunk_bytes=chunk_bytes, with_data=with_data), CHUNKS_DDL)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: one row per record, from its last chunk."""
    folder, manifest = write(pages, min_revisit_bytes)
    chunks = read_chunks(folder, manifest, with_data=False)
    total = F.col("chunk_no") * F.lit(CHUNK_BYTES) + F.col("n_bytes")
    response = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        "page_id",
        F.when(response, total).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = r"""
with t as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as top from t),
b as (select *, list_transform(range(8), lambda g: ('0x' || substr(hex, (g * 5 + 1)::int, 5))::bigint) as v from h)
select page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::int + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from b
"""
