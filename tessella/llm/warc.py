"""Web pages as WARC records in seekable Zstandard bundles, and back.

A bundle is a ``.warc.zst`` file of independent Zstandard frames, each with whole
records of about a megabyte (a longer record is alone in its frame), and a seek
table in a skippable frame at the end: compressed size, size and check sum of every
frame. The index maps each record to its bundle, its frame and the record's place
in the frame, so one record costs one read and one frame.

Each task writes bundles of its own under names that no other attempt uses. What
counts is the index, which holds only what successful tasks returned, so files of
lost or repeated attempts are never read. Reading is split by frames, not by files.

Records with one payload (equal bytes, compared by length and SHA-256) are written
once: that with the largest page_id is the ``response``, those with a smaller id
are ``revisit`` records without the payload. A null page_id counts as smaller than
all others; rows that share payload and largest page_id are all responses, as no id
could tell them apart. Null html is the empty payload. A null url gives no target
line; control characters in a url are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import folder, stored

#: Bytes of records in a frame, and compressed bytes after which the next bundle begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 30
#: Records of one payload go to so many tasks where it is among the most frequent.
SALTS = 256
INDEX = "page_id long, record_type string, bundle string, frame_at long, frame_bytes long, frame_raw long, record_at long, record_bytes long"
RECORDS = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"

# fixed values of the seekable format: magic numbers of the skippable frame and of its footer, flag for check sums
SKIPPABLE, SEEKABLE, WITH_SUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    return None if name in (None, "<urn:page:null>") else int(name[len("<urn:page:") : -1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit, which has the head of the answer only, if it refers to another."""
    again = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + regex.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if again:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = head if again else head + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {uuid.uuid4().urn.join('<>')}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\n"
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields from ``at`` on, and where what follows them begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse(data: bytes, at: int, payload: bool) -> tuple[tuple | None, int]:
    """(values of RECORDS, end) of the record at a place; None for records other than pages."""
    head, body = _headers(data, at)
    end = body + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None, end + 4
    http, start = _headers(data, body)
    size, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    content, intact = None, True
    if kind == "response":
        content = data[start:end]
        found = base64.b32encode(hashlib.sha1(content).digest()).decode()
        intact = found == digest and size == len(content)
        digest, size = found, len(content)
    row = (_id(head["warc-record-id"]), kind, head.get("warc-target-uri"), size, digest, _id(head.get("warc-refers-to")), intact, content if payload else None)
    return row, end + 4


@dataclass
class Bundle:
    """Writes records into frames and, at the end, the seek table."""

    path: str
    date: str
    entries: list[tuple[int, int, int]] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        files, where = _files(self.path)
        files.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(where, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frame, self.rows = io.BytesIO(), []
        self.frame.write(_info(self.date))

    def add(self, page_id: int | None, kind: str, data: bytes) -> Iterator[tuple]:
        """Index rows of the frame that was full before this record came."""
        if self.frame.tell() and self.frame.tell() + len(data) > FRAME_BYTES:
            yield from self.flush()
        self.rows.append((page_id, kind, self.frame.tell(), len(data)))
        self.frame.write(data)

    def flush(self) -> Iterator[tuple]:
        raw = self.frame.getvalue()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        for page_id, kind, at, size in self.rows:
            yield page_id, kind, self.path, self.size, len(packed), len(raw), at, size
        self.size += len(packed)
        self.frame, self.rows = io.BytesIO(), []

    def close(self) -> Iterator[tuple]:
        if self.frame.tell():
            yield from self.flush()
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), WITH_SUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_INDEX = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string())] + [(c, pa.int64()) for c in ("frame_at", "frame_bytes", "frame_raw", "record_at", "record_bytes")])
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())]
)


def with_latest(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and ``latest``: the largest page_id of its payload if the payload has ``least`` bytes and occurs again, else null.

    The pages of a payload that holds more than a thousandth of all repeated pages
    (so of a thousand payloads at most) are dealt to SALTS tasks.
    """
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = named.withColumn("_sum", F.concat(F.sha2("html", 256), F.octet_length("html").cast("string")))
    again = named.where(F.octet_length("html") >= least).groupBy("_sum").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    again = stored(again)
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in again.where(F.col("n") * 1000 > total).select("_sum").collect()]
    frequent = F.col("_sum").isin(hot)
    dealt = F.when(frequent, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int")
    spread = F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    left = named.withColumn("_salt", dealt)
    return left.join(again.select("_sum", "latest", spread), ["_sum", "_salt"], "left").select("page_id", "url", "html", "latest")


def write_archives(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> DataFrame:
    """Writes a record for each page into bundles below ``path``; returns the stored index.

    least: payloads with fewer bytes are written whole each time. date: the WARC-Date
    of all records, as pages carry none. path: a shared folder; by default a new one
    in the session's checkpoint folder.
    """
    base = path or folder(pages.sparkSession)

    def run(batches):
        part, bundle, number, out = TaskContext.get().partitionId(), None, 0, []
        attempt = uuid.uuid4().hex
        for batch in batches:
            for page_id, url, html, latest in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    bundle = Bundle(f"{base}/pages-{part:06d}-{number:04d}-{attempt}.warc.zst", date)
                refers = latest if latest is not None and (page_id is None or page_id < latest) else None
                out += bundle.add(page_id, "response" if refers is None else "revisit", record(page_id, url, html.encode(), refers, date))
                if bundle.size >= BUNDLE_BYTES:
                    out += bundle.close()
                    bundle, number = None, number + 1
            yield _table(out, _INDEX)
            out = []
        if bundle is not None:
            yield _table(list(bundle.close()), _INDEX)

    return stored(with_latest(pages, least).mapInArrow(run, INDEX))


def seek_table(path: str) -> np.ndarray:
    """Rows (place, compressed size, size, check sum) of the frames of a bundle."""
    files, where = _files(path)
    size = files.get_file_info(where).size
    with files.open_input_file(where) as f:
        f.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_SUMS:
            raise ValueError(f"{path} has no seek table")
        f.seek(size - FOOTER.size - n * ENTRY.size)
        found = np.frombuffer(f.read(n * ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(found[:, 0])[:-1]]) if n else np.zeros(0, np.int64)
    return np.column_stack([places, found])


def _frame(path: str, at: int, size: int, raw: int, check: int | None = None) -> bytes:
    files, where = _files(path)
    with files.open_input_file(where) as f:
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=raw)
    if check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"{path}: the frame at {at} is damaged")
    return data


def frames(bundles: DataFrame) -> DataFrame:
    """bundle, at, size, raw, check of every frame of the bundles (one path a row), from their seek tables."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = seek_table(path)
                names = pa.array([path] * len(found), pa.string())
                yield pa.RecordBatch.from_arrays([names, *(pa.array(found[:, k]) for k in range(4))], names=["bundle", "at", "size", "raw", "check"])

    return bundles.select("bundle").mapInArrow(run, "bundle string, at long, size long, raw long, check long")


def read_archives(index: DataFrame, payload: bool = False, task_bytes: int = 64 << 20) -> DataFrame:
    """Every page record of the bundles that an index names, read back from the files (columns RECORDS; payload null unless asked for).

    intact: the payload of a response has the digest and the length that its head states.
    """
    spark = index.sparkSession
    found = index.select("bundle", "frame_at", "frame_raw").distinct()
    total = found.agg(F.sum("frame_raw")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // task_bytes + 1)
    bundles = index.select("bundle").distinct()

    def run(batches):
        for batch in batches:
            for path, at, size, raw, check in zip(*(c.to_pylist() for c in batch.columns)):
                data, place, rows = _frame(path, at, size, raw, check), 0, []
                while place < len(data):
                    row, place = parse(data, place, payload)
                    if row is not None:
                        rows.append(row)
                yield _table(rows, _RECORDS)

    return frames(bundles).repartition(int(tasks), "bundle", "at").mapInArrow(run, RECORDS)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records (RECORDS, with payload) of the page_ids in ``wanted``: only their frames are read, each once a task."""
    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").select("bundle", "frame_at", "frame_bytes", "frame_raw", "record_at")

    def run(batches):
        held, data = None, b""
        for batch in batches:
            rows = []
            for path, at, size, raw, place in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (path, at):
                    held, data = (path, at), _frame(path, at, size, raw)
                rows.append(parse(data, place, True)[0])
                if sum(len(r[-1] or b"") for r in rows) > FRAME_BYTES:
                    yield _table(rows, _RECORDS)
                    rows = []
            yield _table(rows, _RECORDS)

    return places.repartition("bundle", "frame_at").sortWithinPartitions("bundle", "frame_at").mapInArrow(run, RECORDS)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages into bundles and reads all of them back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    return read_archives(write_archives(pages, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
