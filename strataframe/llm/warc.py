"""WARC bundles in seekable Zstandard.

Records are grouped into frames of about FRAME_BYTES that decompress on their own; a bundle ends with
the seek table of the public seekable format (a skippable frame of compressed and plain sizes and a
footer). An index row per record holds bundle, frame, the frame's place in the bundle and the
record's place in the frame, so one record costs one frame. A task writes the bundles of its own
partition under names of their own and lists only what it finished: a lost or repeated task leaves
files that no index row names.

Equal payloads of at least `least` bytes are stored once: the record with the largest id is the response, the
others are revisits of it. Payloads meet by digest; the digests that occur twice or more are broadcast
while few and joined by a shuffle beyond, which splits a hot digest's rows.

Defined results: a null payload is empty; a null id is a revisit if an equal payload has an id, else
a response; repeated ids of the largest value are all responses; a null url has no target header; line ends in
urls are percent-encoded; an empty table gives no bundle and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import materialize, shared_path, slices

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 1 << 28, 3
#: Plain bytes of records that a task reads back.
TASK_BYTES = 1 << 26
#: Digests found twice or more are broadcast up to so many, of 40 bytes and an id each.
BROADCAST_ROWS = 200_000
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit carries the digest and length of the payload, not the payload."""
    block = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record without its end")
    return head, data[start:stop], stop + 4


class Bundle:
    """Writes records into frames and the seek table behind them."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.at, self.frames = [], 0, 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """The frame's number, the record's place in it and its length."""
        if self.held and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((self.at, len(packed), self.size))
            self.at += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", packed, plain) for _, packed, plain in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(place, compressed bytes, plain bytes) of each frame, from the footer of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * width)
    table, out, at = f.read(n * width), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def typed(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, kind and refers_to of each row."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    few = groups.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles of pages into a folder that all nodes share, and the index beside them; returns the index."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        bundle, waiting = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            rows = [(page, name, frame, *bundle.frames[frame][:2], at, n) for page, frame, at, n in waiting]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["page_id", "bundle", "frame", "frame_at", "frame_bytes", "at", "bytes"])

        for batch in slices(batches):
            for page, link, data, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle, waiting = Bundle(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes), []
                waiting.append((page, *bundle.add(record(page, link, bytes(data), kind, refers))))
                if bundle.at + bundle.size >= bundle_bytes:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    path = f"{folder}/index"
    typed(pages, least, key, url, payload).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read(index: DataFrame, folder: str) -> DataFrame:
    """All records that the index names, read from the bundles frame by frame: page_id, url, payload (null
    for a revisit), payload_bytes, payload_digest, record_type and refers_to. A response whose payload
    doesn't match its digest, or an index row that isn't a record's place, is an error."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = store(folder)
        unzip, opened, held, frame = zstandard.ZstdDecompressor(), None, (None, None), b""
        for batch in slices(batches):
            rows, size = [], 0
            for bundle, at, n, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened is None or opened[0] != bundle:
                    opened = (bundle, files.open_input_file(f"{root}/{bundle}"))
                if held != (bundle, at):
                    opened[1].seek(at)
                    held, frame = (bundle, at), unzip.decompress(opened[1].read(n))
                head, block, end = parse(frame, start)
                if end != start + length:
                    raise ValueError(f"{bundle}: the index and the record at {at}, {start} differ")
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"{bundle}: damaged payload")
                number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x and x != "<urn:page:>" else None
                rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), payload, int(head["WARC-Payload-Length"]), digest, kind, number(head.get("WARC-Refers-To"))))
                size += length
                if size >= 8 << 20:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    # as many tasks as the records' bytes ask for: the index is small, so its own size would put all of it into one
    size = index.agg(F.sum("bytes")).first()[0] or 0
    parts = index.select("bundle", "frame_at", "frame_bytes", "at", "bytes").repartition(max(1, -(-size // TASK_BYTES)), "bundle", "frame_at").sortWithinPartitions("bundle", "frame_at", "at")
    return parts.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(folder: str, bundle: str, frame_at: int, frame_bytes: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row: one read of one frame."""
    import zstandard

    files, root = store(folder)
    with files.open_input_file(f"{root}/{bundle}") as f:
        f.seek(frame_at)
        data = zstandard.ZstdDecompressor().stream_reader(BytesIO(f.read(frame_bytes))).read()
    head, block, _ = parse(data, at)
    return head, block


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder).drop("url", "payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
