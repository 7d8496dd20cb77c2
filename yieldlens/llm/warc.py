"""Web archives packaged in ZIP files: a writer, and a reader that never extracts.

``write_archives`` stores pages as gzip-compressed WARC records. Each archive is a
ZIP file with two stored (uncompressed) members, ``archive/data.warc.gz`` and its
index ``indexes/index.cdxj`` (a line per record: key, time and a JSON object with
offset, length, digest and page_id). Of pages with equal payloads the one with the
smallest page_id is written as a response, the others as revisits.

``read_archives`` opens an archive for random access, finds the end record and the
central directory (ZIP64 forms too), locates the stored members, reads the index,
and reads each record as one byte range of the archive.

Tasks write archives of about ``ARCHIVE_BYTES`` under the shared folder by any
path that ``pyarrow.fs`` knows, each under a name of its own, and return names and
sizes; that list is stored, so only archives of finished tasks are ever read.

Edge cases: a null html is an empty payload; a null url is written as an empty
target; rows that tie on the smallest page_id are all responses; a null page_id
counts only where no other row has the payload; repeated rows give a record each;
empty tables give no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_folder, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 32 << 20
_DATE = "2024-01-01T00:00:00Z"      # records carry no time of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records -------------------------------------------------------------------------------------
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def _target(url: str | None) -> str:
    return "".join(" " if c < " " else c for c in url or "")


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers but not the payload."""
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))],
                    "HTTP/1.1 200 OK")
    block = http + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
             ("WARC-Date", _DATE), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
             ("X-Page-ID", json.dumps(page_id))]
    if kind == "revisit":
        lines += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", json.dumps(refers_to)),
                  ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(lines, "WARC/1.1") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one (uncompressed) record; response payloads are checked against their digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(told["content-length"])):
        raise ValueError(f"damaged record of page {h['x-page-id']}")
    return {"page_id": json.loads(h["x-page-id"]), "url": h["warc-target-uri"],
            "payload_bytes": int(told["content-length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": json.loads(h["x-refers-to-page-id"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


# ---- ZIP directories -----------------------------------------------------------------------------
class Ranges:
    """Byte ranges of one file."""

    def __init__(self, uri: str):
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
            fs.LocalFileSystem(), uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("range outside the archive")
        return self.file.read_at(n, at)


def central_directory(file) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory, from the end record or its ZIP64 form."""
    tail_at = max(0, file.size - 65557)                      # the end record and the longest comment
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))     # room for the record's 22 bytes
    while at >= 0 and struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22:
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = file.read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, size, offset = struct.unpack_from("<QQQ", end, 32)
    return offset, size, entries


def members(file) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, bytes) of every stored member."""
    offset, size, entries = central_directory(file)
    directory, at, found = file.read(offset, size), 0, {}
    for _ in range(entries):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:                                     # ZIP64: only the fields that overflowed, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        at += 46 + n_name + n_extra + n_note
        if method == 0:
            head = file.read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("damaged local header")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), plain)
    return found


def records(file) -> Iterator[dict]:
    """The records that the index names, each read as one range."""
    inside = members(file)
    start, length = inside[DATA]
    for line in file.read(*inside[INDEX]).decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])
        if entry["offset"] + entry["length"] > length:
            raise ValueError("index points outside its member")
        yield parse_record(gzip.decompress(file.read(start + entry["offset"], entry["length"])))


# ---- Spark ---------------------------------------------------------------------------------------
class _Archive:
    """One archive in the making."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        self.data, self.index, self.count = io.BytesIO(), [], 0

    def add(self, page_id, url, payload, digest, kind, refers_to) -> None:
        at = self.data.tell()
        self.data.write(gzip.compress(record(kind, page_id, url, payload, digest, refers_to), 6, mtime=0))
        entry = {"offset": at, "length": self.data.tell() - at, "digest": digest, "mime": "text/html",
                 "page_id": page_id, "type": kind}
        self.index.append(f"{_target(url).replace(' ', '%20') or '-'} 20240101000000 {json.dumps(entry)}")
        self.count += 1

    def close(self) -> dict:
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(self.uri) if ":" in self.uri.split("/")[0] else (
            fs.LocalFileSystem(), self.uri)
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(DATA), self.data.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.index)))
        return {"uri": self.uri, "records": self.count}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; (uri, records) of each. Payloads under ``min_bytes`` are never revisits."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    firsts = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    joined = rows.join(stored(firsts.drop("n"), "warc-firsts"), "sha1", "left")

    def run(batches):
        archive, done = _Archive(folder), []
        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if first is None or first == page_id else "revisit"
                archive.add(page_id, url, payload, payload_digest(payload), kind, first if kind == "revisit" else None)
                if archive.data.tell() >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = _Archive(folder)
        if archive.count:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("uri", pa.string()), ("records", pa.int64())]))

    return stored(arrow_map(joined.select("page_id", "url", "payload", "first"), run, "uri string, records long"),
                  "warc-list")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives listed in column ``uri``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, if wanted, payload (null for revisits)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                part, held = [], 0
                for r in records(Ranges(uri)):
                    part.append({k: r[k] for k in kinds})
                    held += r["payload_bytes"] if payloads else 100
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part, held = [], 0
                yield pa.RecordBatch.from_pylist(part, schema)

    text = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    tasks = max(1, archives.count())                         # a number that adaptive execution leaves alone
    return arrow_map(archives.select("uri").repartition(tasks, "uri"), run, text + (", payload binary" if payloads else ""))


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Pages written to archives under the shared folder and read back."""
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc")), payloads=False)
