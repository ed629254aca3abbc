"""WARC archives whose records are compressed with a dictionary of their own archive.

An archive begins with a skippable frame that holds a Zstandard dictionary,
built from the archive's first records; every record then is a frame of its own,
compressed with the dictionary. A task writes its rows as a stream, holds no
more than the dictionary's sample, and starts a new archive when one is full.

Of records with equal payloads of `min_bytes` or more, that with the smallest
page id is a response and the others are revisits that refer to it.

Archives go to the cluster's shared folder, under names that no other attempt
uses, and count once they are in the manifest that the tasks return; what a lost
executor leaves behind is never read.

Edge cases: null html is an empty payload; null ids come last, and a payload
that only null ids hold has responses only; rows that repeat the smallest id of
their payload are all responses; null URLs have no target; an empty table gives
no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import sized_join
from quillspark.storage import arrow_filesystem, materialise, new_path

MIN_BYTES = 100
#: Uncompressed bytes of an archive, of the dictionary's sample, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 256 << 20, 1 << 20, 32 << 10
LEVEL = 3
#: Fixed values of the format: the skippable frame that holds a dictionary.
DICT_FRAME = 0x184D2A5D
CAPTURED = "1970-01-01T00:00:00Z"
MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit holds no payload."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary; the sample itself, as raw content, if it is too small to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[-DICT_BYTES:]


class Archive:
    """Writer of one archive."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.held: list[bytes] = []
        self.size = self.records = 0
        self.out = self.compressor = None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(data))
            return
        self.held.append(data)
        if self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        raw = build_dictionary(self.held)
        system, path = arrow_filesystem(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        # The stream would compress by the suffix if left to itself.
        self.out = system.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> dict:
        if not self.compressor:
            self.start()
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.size}


def write_partition(batches, folder: str):
    """Manifest rows of the archives that a task has written."""
    archive = None
    for batch in batches:
        done = []
        for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
            payload = b"" if html.as_py() is None else html.as_py().encode()
            archive = archive or Archive(folder)
            archive.add(record(page_id.as_py(), url.as_py(), payload, hashlib.sha256(payload).hexdigest(), refers_to.as_py()))
            if archive.size >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None
        if done:
            yield pa.RecordBatch.from_pylist(done, MANIFEST)
    if archive:
        yield pa.RecordBatch.from_pylist([archive.close()], MANIFEST)


def read_archive(path: str):
    """(headers, payload) of each record; digests of stored payloads are verified."""
    system, name = arrow_filesystem(path)
    with system.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICT_FRAME:
            raise ValueError(f"{path} doesn't begin with a dictionary frame")
        raw = source.read(size)
        engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        with engine.stream_reader(source, read_across_frames=True) as stream:
            lines = io.BufferedReader(stream, 1 << 20)
            while first := lines.readline():
                if first != b"WARC/1.1\r\n":
                    raise ValueError(f"{path}: {first[:40]!r} begins no record")
                headers = {}
                while (line := lines.readline()) != b"\r\n":
                    key, _, value = line.decode().rstrip("\r\n").partition(": ")
                    headers[key] = value
                block = lines.read(int(headers["Content-Length"]))
                lines.read(4)
                payload = block.partition(b"\r\n\r\n")[2]
                if headers["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} is damaged")
                yield headers, payload


def read_partition(batches, with_payload: bool):
    """Rows of the archives named in a manifest."""
    number = lambda v: None if v is None else int(v)
    columns = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            rows, held = [], 0
            for h, payload in read_archive(path):
                rows.append((number(h.get("X-Page-Id")), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].partition(":")[2], h["WARC-Type"], number(h.get("X-Refers-To-Page")), h.get("WARC-Target-URI"), payload if with_payload else None))
                held += len(payload) if with_payload else 0
                if len(rows) >= 2000 or held > 1 << 24:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Manifest (path, records, bytes) of the archives of `pages` (page_id, url, html)."""
    folder = new_path(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit(""))
    digests = pages.filter(F.octet_length("html") >= min_bytes).groupBy(F.sha2(payload, 256).alias("digest")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    several = materialise(digests.filter("n > 1 and first is not null").select("digest", "first"), "equal-payloads")
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    joined = sized_join(keyed, several, ["digest"], "left", [F.col("page_id"), F.col("url")])  # a payload may be that of a third of all pages
    rows = joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return materialise(rows.mapInArrow(lambda it: write_partition(it, folder), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows as read from the archives; payload is null for revisits and unless asked for."""
    tasks = max(1, manifest.count())
    return manifest.select("path").repartition(tasks, "path").mapInPandas(lambda it: read_partition(it, with_payload), ROWS)
