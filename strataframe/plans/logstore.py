"""A log store: append-only change-log files are the database, and an index points at each key's newest record.

A file is a number and the segments appended under it, Parquet folders of (key, seq, ts, tombstone, value); (file_id, part, seq)
orders all writes. The newest file takes appends until it holds max_file_bytes, then it is sealed and the next one begins.
Compaction rewrites the sealed files into one that takes the lowest id, so it stays older than what was
written since, and writes hints beside it: each live key's pointer without its value,
from which the index is read.

A version lists the segments, and its rename is the only commit. Files that no kept version names go once they are
grace_seconds old, on a writer's open and by vacuum(), so readers of an older version end in peace. Without a manifest, all whole segments
found are adopted; a damaged manifest is an error, and nothing is deleted. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.model import CHANGELOG, NO_KEY, Code, Options, Status, StoreError, check_key, corruption, invalid
from strataframe.operators.resolve import latest
from strataframe.operators.stats import RECORD_HEADER, reclaimable, size_of
from strataframe.plans.files import Files

ORDER = ["file_id", "part", "seq"]
#: Names of append and compaction steps at which a test may stop the store as if it had died.
STEPS = ("data_written", "hints_written", "before_commit", "committed")
HINTS = "key binary, seq long, ts long, tombstone boolean, size long"


class LogStore:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options(), stop_at: Callable[[str], None] | None = None, writer: bool = True):
        self.spark, self.files, self.options, self.writer = spark, Files(spark, root), options, writer
        self.root, self.stop = self.files.root, stop_at or (lambda step: None)
        versions = self.versions()
        try:
            self.state = json.loads(self.files.read(f"manifest/{versions[-1]:012d}.json")) if versions else self._adopt()
            self.state["segments"], self.state["version"]  # noqa: B018
        except (ValueError, KeyError, TypeError) as e:
            raise corruption(f"damaged manifest: {e}") from None
        if writer and versions:
            self.vacuum()

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names("manifest") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _adopt(self) -> dict:
        """The whole segments that are there, in the order of their numbers."""
        found = []
        for d in self.files.names("log"):
            names = self.files.names(f"log/{d}")
            if (m := re.fullmatch(r"(\d+)-(\d+)-[0-9a-f]+", d)) and "_SUCCESS" in names:
                found.append({"file": int(m[1]), "part": int(m[2]), "folder": d, "size": sum(names.values()), "hints": "_SUCCESS" in self.files.names(f"hint/{d}")})
        return {"version": 0, "segments": sorted(found, key=lambda x: (x["file"], x["part"]))}

    def vacuum(self, keep: int | None = None, older_than: float | None = None) -> list[str]:
        """Drops old versions but the last `keep`, and segments and hints that no kept version names and that are old enough."""
        age, versions = self.options.grace_seconds if older_than is None else older_than, self.versions()
        kept = versions[-(keep or self.options.keep_versions) :]
        named = {x["folder"] for v in kept for x in json.loads(self.files.read(f"manifest/{v:012d}.json"))["segments"]}
        gone = [f"manifest/{v:012d}.json" for v in versions[: -len(kept)]]
        gone += [f"{kind}/{d}" for kind in ("log", "hint") for d, old in self.files.ages(kind).items() if d not in named and old >= age]
        gone += [f"manifest/{n}" for n, old in self.files.ages("manifest").items() if n.endswith(".tmp") and old >= age]
        for name in gone:
            self.files.delete(name)
        return gone

    def _commit(self, segments: list[dict]) -> None:
        self.stop("before_commit")
        state = {"version": self.state["version"] + 1, "segments": sorted(segments, key=lambda x: (x["file"], x["part"]))}
        self.files.write(f"manifest/{state['version']:012d}.json", json.dumps(state).encode(), new=True)
        self.state = state
        for v in self.versions()[: -self.options.keep_versions]:
            self.files.delete(f"manifest/{v:012d}.json")
        self.stop("committed")

    def _write(self, rows: DataFrame, file: int, part: int, hints: bool = False) -> dict:
        folder = f"{file:06d}-{part:06d}-{uuid.uuid4().hex[:8]}"
        rows.select("key", "seq", "ts", "tombstone", "value").write.parquet(f"{self.root}/log/{folder}")
        self.stop("data_written")
        if hints:
            written = self.spark.read.schema(CHANGELOG).parquet(f"{self.root}/log/{folder}")
            size = size_of(RECORD_HEADER, F.col("key"), F.col("value")).cast("long")
            written.select("key", "seq", "ts", "tombstone", size.alias("size")).write.parquet(f"{self.root}/hint/{folder}")
            self.stop("hints_written")
        return {"file": file, "part": part, "folder": folder, "size": sum(self.files.names(f"log/{folder}").values()), "hints": hints}

    def _active(self) -> tuple[int, int]:
        """The file and part that the next append takes; a full file is sealed first."""
        if not self.state["segments"]:
            return 1, 0
        newest = self.state["segments"][-1]
        if newest["hints"] or sum(x["size"] for x in self.state["segments"] if x["file"] == newest["file"]) >= self.options.max_file_bytes:
            return newest["file"] + 1, 0
        return newest["file"], newest["part"] + 1

    def append(self, changes: DataFrame) -> None:
        """A batch of (key, seq, tombstone, value), newer than all before it; an empty or null key fails it whole."""
        if not self.writer:
            raise invalid("this store was opened to read")
        key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit(NO_KEY)))
        rows = changes.select(key.alias("key"), F.col("seq").cast("long"), F.current_timestamp().cast("long").alias("ts"), "tombstone", F.when(~F.col("tombstone"), F.col("value")).alias("value"))
        try:
            made = self._write(rows, *self._active())
        except PySparkException as e:
            if NO_KEY in str(e):
                raise invalid(NO_KEY) from None
            raise
        self._commit([*self.state["segments"], made])

    def _one(self, key: bytes, value: bytes | None) -> Status:
        try:
            row = (bytearray(check_key(key)), 0, value is None, None if value is None else bytearray(value))
            self.append(self.spark.createDataFrame([row], "key binary, seq long, tombstone boolean, value binary"))
        except StoreError as e:
            return e.status
        return Status()

    def put(self, key: bytes, value: bytes) -> Status:
        return self._one(key, bytes(value))

    def remove(self, key: bytes) -> Status:
        return self._one(key, None)

    def _read(self, kind: str, schema, segments: list[dict]) -> DataFrame:
        """Rows of segments with the file and part that their folder's name tells."""
        if not segments:
            return self.spark.createDataFrame([], schema).select("*", F.lit(0).cast("long").alias("file_id"), F.lit(0).cast("long").alias("part"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{kind}/{x['folder']}" for x in segments))
        number = lambda i: F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}/(\d+)-(\d+)-[^/]+/", i).cast("long")
        return rows.select("*", number(1).alias("file_id"), number(2).alias("part"))

    def log(self) -> DataFrame:
        """All records, with the file and part they are in."""
        return self._read("log", CHANGELOG, self.state["segments"])

    def live(self) -> DataFrame:
        return latest(self.log(), seq=ORDER).select("key", "value")

    def index(self) -> DataFrame:
        """Pointers: key, file_id, part, offset (place in the part), size and ts of each key's newest live record. Segments with
        hints are read from them unless ignore_hints; no value is read there."""
        hinted = [x for x in self.state["segments"] if x["hints"] and not self.options.ignore_hints]
        others = [x for x in self.state["segments"] if x not in hinted]
        size = size_of(RECORD_HEADER, F.col("key"), F.col("value")).cast("long")
        rows = self._read("log", CHANGELOG, others).select("key", "seq", "ts", "tombstone", size.alias("size"), "file_id", "part")
        if hinted:
            rows = rows.unionByName(self._read("hint", HINTS, hinted))
        return latest(rows, seq=ORDER).select("key", "file_id", "part", F.col("seq").alias("offset"), "size", "ts")

    def records(self, pointers: DataFrame) -> DataFrame:
        """key and value of the records at pointers (key, file_id, part, offset)."""
        at = pointers.select("key", "file_id", "part", F.col("offset").alias("seq"))
        return self.log().join(at, ["key", *ORDER], "left_semi").select("key", "value")

    def get(self, key: bytes) -> tuple[Status, bytes | None]:
        try:
            key = check_key(key)
        except StoreError as e:
            return e.status, None
        found = latest(self.log().where(F.col("key") == F.lit(key)), seq=ORDER).select("value").collect()  # one row at most
        return (Status(), bytes(found[0].value)) if found else (Status(Code.NOT_FOUND), None)

    def key_count(self) -> int:
        return self.live().count()

    def reclaimable(self) -> DataFrame:
        rows = self.log().withColumn("order", F.struct(*ORDER))
        return reclaimable(rows, "file_id", size_of(RECORD_HEADER, F.col("key"), F.col("value")), seq="order")

    def compact(self) -> bool:
        """Rewrites all files but the newest; False if there is none. What it replaces goes later, by vacuum()."""
        if not self.writer:
            raise invalid("this store was opened to read")
        files = sorted({x["file"] for x in self.state["segments"]})
        if len(files) < 2:
            return False
        sealed = [x for x in self.state["segments"] if x["file"] != files[-1]]
        newest = [x for x in self.state["segments"] if x["file"] == files[-1]]
        kept = latest(self._read("log", CHANGELOG, sealed), seq=ORDER).select("key", F.monotonically_increasing_id().alias("seq"), "ts", "tombstone", "value")
        made = self._write(kept, files[0], 0, hints=True)
        self._commit([made, *newest])
        return True

    def file_count(self) -> int:
        return len({x["file"] for x in self.state["segments"]})

    def segments(self) -> DataFrame:
        rows = [(x["file"], x["part"], x["folder"], x["size"], x["hints"]) for x in self.state["segments"]]
        return self.spark.createDataFrame(rows, "file_id long, part long, folder string, size long, hints boolean")

    def total_disk_size(self) -> int:
        return sum(x["size"] for x in self.state["segments"])
