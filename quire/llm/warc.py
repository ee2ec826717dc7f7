"""WARC archives with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Payloads that equal an earlier one become revisit records. Which record is the response is settled by an aggregate
over payload digests; archives are written by each task under a name of its own and listed in a committed manifest,
so a repeated task leaves files that nobody reads, never a record twice.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_folder, written

DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLES = 400


def _urn(page_id: object) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One record; refers_to: the page of the response that a revisit points to. A revisit keeps the HTTP header only."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The records as an archive; the dictionary is made from the first SAMPLES of them, and empty if they are too few."""
    import zstandard

    dictionary = b""
    if len(records) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[:SAMPLES]).as_bytes()
        except zstandard.ZstdError:
            pass  # samples that are too small or too alike make no dictionary
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **known)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(packer.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """What each frame of an archive holds, decoded with the dictionary of the leading skippable frame."""
    import zstandard

    view, at, known = memoryview(data), 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        at = 8 + size
        if at > len(data):
            raise ValueError("the dictionary is cut off")
        dictionary = data[8:at]
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        if dictionary:
            known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
    reader, step = zstandard.ZstdDecompressor(**known), 1 << 14
    while at < len(data):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            chunk = view[at : at + step]
            out.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(out)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        out[name.strip().lower().decode("ascii")] = value.strip().decode()
    return out


def parse(data: bytes) -> dict:
    """The record that a frame holds; raises ValueError unless its version, headers, lengths and digest are right."""
    head, gap, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    if not h["content-length"].isdigit() or int(h["content-length"]) != len(rest) - 4 or rest[-4:] != CRLF + CRLF:
        raise ValueError("the length of the block is wrong")
    http, gap, payload = rest[:-4].partition(CRLF + CRLF)
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = int(_headers(http.split(CRLF)[1:]).get("content-length", len(payload)))
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if h["warc-type"] == "response":
        if length != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload does not fit its length or digest")
    elif h["warc-type"] != "revisit" or "warc-refers-to" not in h or payload:
        raise ValueError("neither a response nor a revisit")
    page = lambda urn: urn[len("<urn:page:") : -1]
    refers = page(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
    return {"page_id": page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": refers, "payload_bytes": length, "payload_digest": digest, "payload": payload if refers is None else None}


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task, held, size, made = TaskContext.get(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            name = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.zst"
            data = archive(held)
            with store.open_output_stream(name) as out:
                out.write(data)
            done = pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])
            held, size, made = [], 0, made + 1
            return done

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                held.append(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), first.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of pages into archives; returns their manifest (path, records, bytes).

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the smallest id is the response (rows that
    tie for it all are), others are revisits. A null payload is empty. A null id is written as such and never a response
    to others unless it is alone; urls may be null. An empty table writes nothing.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    least = slim.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest", "least")
    full = slim.join(least, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("least").eqNullSafe(F.col("page_id")), F.col("least")).alias("first"))
    folder = folder or new_folder(pages.sparkSession, "warc")
    return written(full.mapInArrow(_writer(folder), "path string, records long, bytes long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = _store(path)
            with store.open_input_stream(name) as f:
                data = f.read()
            rows = []
            for frame in frames(data):
                rows.append(parse(frame))
                if len(rows) >= 200:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))


RECORD_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a table with a column ``path`` names; a damaged archive raises ValueError."""
    n = max(1, manifest.count())  # archives are dealt over tasks, a few each
    return manifest.select("path").repartition(min(n, 4096), "path").mapInArrow(_reader, RECORD_SCHEMA)
