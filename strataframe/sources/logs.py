"""Reading the documented file formats with Spark: one task per file, as records follow one another in it."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.model import StoreError, corruption
from strataframe.plans.files import Files
from strataframe.sources import formats

LOG_SCHEMA = "file_id long, offset long, size long, key binary, ts long, tombstone boolean, value binary"
TABLE_SCHEMA = "table_id long, place long, key binary, tombstone boolean, value binary"
LOG_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
TABLE_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
NAME = re.compile(r"(\d+)\.(log|wal|hint|sst)$")
#: Records of a file that leave a task together.
ROWS = 4096


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    """id, path and content of files, one at a time; of a batch, one file at a time becomes a Python object."""
    for batch in batches:
        for name, data in zip(*batch.columns, strict=True):
            if m := NAME.search(name.as_py()):
                yield int(m[1]), name.as_py(), data.as_py()


def read_logs(spark: SparkSession, path: str, kind: str = "log") -> DataFrame:
    """Records of all log or write-ahead files of a folder. The newest file's torn tail is left out; damage in an
    older, sealed one is an error for logs."""
    files = _files(spark, path, kind)
    names = [m for n in Files(spark, path).names("") if n.endswith(f".{kind}") and (m := NAME.search(n))]  # empty files too
    newest = max((int(m[1]) for m in names), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, name, data in _each(batches):
            end = 0
            for rows in itertools.batched(formats.scan_records(data), ROWS):
                yield _made([(id_, at, size, r.key, r.ts, r.tombstone, None if r.tombstone else r.value) for at, size, r in rows], LOG_KINDS, LOG_SCHEMA)
                end = rows[-1][0] + rows[-1][1]
            if end < len(data) and id_ != newest and kind == "log":
                raise corruption(f"{name} is damaged at {end}, and it is sealed")

    return files.mapInArrow(run, LOG_SCHEMA)


def read_tables(spark: SparkSession, path: str, begin: bytes = b"", end: bytes = b"") -> DataFrame:
    """Entries with keys of [begin, end) of all table files of a folder, checksums verified; of each table only the
    blocks that may hold such keys are parsed. place: the entry's among those read of its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, _, data in _each(batches):
            for rows in itertools.batched(enumerate(formats.Table(data).range(begin, end)), ROWS):
                yield _made([(id_, i, e.key, e.tombstone, None if e.tombstone else e.value) for i, e in rows], TABLE_KINDS, TABLE_SCHEMA)

    return _files(spark, path, "sst").mapInArrow(run, TABLE_SCHEMA)


def read_index(spark: SparkSession, path: str, ignore_hints: bool = False) -> DataFrame:
    """The pointers of all log files of a folder, in a file's order: file_id, offset, size, key, ts. A hint file that is whole and
    fits its log's size stands for it, so the log isn't parsed; hints without a log are not read. Removed keys have no hint."""
    logs = _files(spark, path, "log").select(F.regexp_extract("path", NAME.pattern, 1).cast("long").alias("id"), "path", "content")
    hints = _files(spark, path, "hint").select(F.regexp_extract("path", NAME.pattern, 1).cast("long").alias("id"), F.col("content").alias("hint"))
    schema = "file_id long, offset long, size long, key binary, ts long, hinted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, log, hint in zip(*batch.columns, strict=True):
                rows, hinted = pointers(hint.as_py(), log.as_py(), ignore_hints)
                yield _made([(id_.as_py(), h.offset, h.size, h.key, h.ts, hinted) for h in rows], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), schema)

    return logs.join(hints, "id", "left").select("id", "content", "hint").mapInArrow(run, schema)


def _made(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def pointers(hint: bytes | None, log: bytes, ignore_hints: bool = False) -> tuple[list[formats.Hint], bool]:
    """The pointers of a log file, and whether its hint file gave them: it does if it is whole and belongs to the log."""
    if hint is not None and not ignore_hints:
        try:
            return formats.decode_hints(hint, len(log)), True
        except StoreError:
            pass
    return [formats.Hint(r.key, r.ts, at, size) for at, size, r in formats.scan_records(log)], False


def hints_or_log(hint: bytes | None, log: bytes, ignore_hints: bool = False) -> list[formats.Hint]:
    return pointers(hint, log, ignore_hints)[0]


def key_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The sparse index of table files: table_id, block, last key, place and size."""
    schema = "table_id long, block long, last_key binary, at long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, _, data in _each(batches):
            yield _made([(id_, i, *x) for i, x in enumerate(formats.Table(data).index)], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), schema)

    return _files(spark, path, "sst").mapInArrow(run, schema)


def as_changes(log: DataFrame) -> DataFrame:
    """Log records as a change log ordered by file and place."""
    return log.withColumn("seq", F.struct("file_id", "offset"))


def write_files(rows: DataFrame, folder: str, file_id: str, encode: Callable[[list[dict]], dict[str, bytes]]) -> DataFrame:
    """Rows grouped by file_id to files of a shared folder, by a codec from a group's rows to contents by name; returns the
    names and sizes written. A group is one file's rows, which the caller bounds; a task that runs again writes the same names."""
    columns = rows.columns

    def run(key: tuple, group: pa.Table) -> pa.Table:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out = encode(group.select(columns).to_pylist())
        for name, data in out.items():
            temporary = f"{root}/.{name}.{uuid.uuid4().hex[:8]}"
            with files.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            files.move(temporary, f"{root}/{name}")
        return pa.table({"name": list(out), "size": pa.array(map(len, out.values()), pa.int64())})

    return rows.groupBy(file_id).applyInArrow(run, "name string, size long")
