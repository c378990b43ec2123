"""A layered store: immutable sorted Parquet tables in levels behind a versioned manifest.

Level 0 holds flushed and ingested batches, newest id first; deeper levels are disjoint ranges. A version lists the
tables of all levels; readers pin one, writers add the next by a rename, and nothing else commits. One writer at a time is
assumed, and a second one's commit fails. A reader (writer=False) changes no file. Files that no kept version names
are swept by a writer's open and by vacuum() once they are `grace_seconds` old, so nothing that another is about to commit goes.

Batches are taken once: of a numbered source (a stream) the store keeps the highest number taken, of other batch ids all.

A batch of any size goes through apply(): Spark resolves, range-partitions and writes it. put() and remove() are for
single keys: they are logged, held in memory and flushed like a batch.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.scalars import level_budget
from strataframe.model import LAYER, MANIFEST, NO_KEY, Code, Options, Status, StoreError, Tombstones, check_key, corruption, invalid
from strataframe.operators.integrity import droppable, held_keys
from strataframe.operators.resolve import in_range, latest
from strataframe.operators.stats import MEMTABLE_ENTRY, amplification, size_of
from strataframe.plans.files import Files
from strataframe.sources.formats import Record, encode_record, scan_records

EMPTY = {"version": 0, "next_id": 1, "levels": [[]], "cursors": {}, "sources": {}, "batches": [], "batch_files": []}
#: Batch ids in the manifest before they move to a file of their own; keys that a batch get hands to the scans as literals;
#: asked keys that are broadcast.
LISTED, LITERALS, BROADCAST_ROWS = 1000, 2000, 200_000
#: Rows of a Parquet page, the block of these tables, and the counters of a store in order.
PAGE_ROWS = 20_000
COUNTERS = ("gets", "tables_probed", "block_reads", "bloom_checks", "bloom_rejects", "bytes_written", "flushes", "wal_records_replayed", "compactions", "compaction_bytes_read", "compaction_bytes_written", "tables_obsoleted")
#: Names of compaction and flush steps at which a test may stop the store as if it had died.
STEPS = ("tables_written", "before_commit", "committed")


def overlap(t: dict, low: str, high: str) -> bool:
    return not (t["high"] < low or high < t["low"])


def scanned_rows(df: DataFrame, column: str = "") -> int:
    """Rows that left the file scans (those that read the column) of a DataFrame that was run."""

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "FileSourceScanExec":
            return plan.metrics().apply("numOutputRows").value() if column in plan.requiredSchema().fieldNames() or not column else 0
        children = plan.children()
        return sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


class LayeredStore:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options(), stop_at: Callable[[str], None] | None = None, writer: bool = True):
        self.spark, self.files, self.options, self.writer = spark, Files(spark, root), options, writer
        self.root, self.counters, self.stop = self.files.root, Counter(), stop_at or (lambda step: None)
        self.memtable: dict[bytes, tuple[bool, bytes | None]] = {}
        self.log = bytearray()
        versions = self.versions()
        try:
            self.state = json.loads(self.files.read(f"manifest/{versions[-1]:012d}.json")) if versions else self._adopt()
            self.state = EMPTY | self.state
            self.state["levels"][0]  # noqa: B018
            self.taken = {*self.state["batches"], *(x for n in self.state["batch_files"] for x in json.loads(self.files.read(n)))}
        except (ValueError, KeyError, IndexError) as e:
            raise corruption(f"damaged manifest: {e}") from None  # and nothing is deleted
        if writer:
            self._sweep()
        self._replay()

    # -- lifecycle

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names("manifest") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _adopt(self) -> dict:
        """Without a manifest every table found is of level 0."""
        found = [f"tables/{d}/{n}" for d in self.files.names("tables") for n in self.files.names(f"tables/{d}") if n.endswith(".parquet")]
        state = json.loads(json.dumps(EMPTY))
        if found:
            state["levels"][0] = sorted(self._described(found), key=lambda t: -t["id"])
            state["next_id"] = max(t["id"] for t in state["levels"][0]) + 1
        return state

    def _sweep(self) -> None:
        for n, age in self.files.ages("manifest").items():
            if n.endswith(".tmp") and age >= self.options.grace_seconds:
                self.files.delete(f"manifest/{n}")
        if self.versions():
            self.vacuum()

    def _replay(self) -> None:
        """Logged single writes, oldest first: into memory, and for a writer on into a table."""
        segments = sorted(n for n in self.files.names("wal") if n.endswith(".wal"))
        for n in segments:
            for _, _, r in scan_records(self.files.read(f"wal/{n}")):
                self.counters["wal_records_replayed"] += 1
                self.memtable[r.key] = (r.tombstone, None if r.tombstone else r.value)
        if segments and self.writer:
            if self.memtable:
                self._flush_rows()
            for n in segments:
                self.files.delete(f"wal/{n}")

    def _commit(self, state: dict) -> None:
        self.stop("before_commit")
        state["version"] = self.state["version"] + 1
        self.files.write(f"manifest/{state['version']:012d}.json", json.dumps(state).encode(), new=True)
        self.state = state
        self.counters["commits"] += 1
        self.stop("committed")

    def refresh(self) -> int:
        """A reader's step to the newest version; returns it."""
        if versions := self.versions():
            self.state = EMPTY | json.loads(self.files.read(f"manifest/{versions[-1]:012d}.json"))
        return self.state["version"]

    def _next(self) -> dict:
        return json.loads(json.dumps(self.state))

    def vacuum(self, keep: int | None = None, older_than: float | None = None) -> list[str]:
        """Drops old versions but the last `keep`, and files that no kept version names and that are `older_than` seconds old
        (grace_seconds); unread DataFrames of dropped versions end."""
        self._writes()
        age = self.options.grace_seconds if older_than is None else older_than
        versions = self.versions()
        kept = versions[-(keep or self.options.keep_versions) :]
        states = [json.loads(self.files.read(f"manifest/{v:012d}.json")) for v in kept]
        named = {t["path"] for state in states for level in state["levels"] for t in level}
        for v in versions[: -len(kept)]:
            self.files.delete(f"manifest/{v:012d}.json")
        gone = []
        for d in self.files.names("tables"):
            files = {f"tables/{d}/{n}": old for n, old in self.files.ages(f"tables/{d}").items() if n.endswith(".parquet")}
            for path, old in files.items():
                if path not in named and old >= age:
                    self.files.delete(path)
                    gone.append(path)
            if files and len(set(gone).intersection(files)) == len(files):
                self.files.delete(f"tables/{d}")
        return gone

    def _writes(self) -> None:
        if not self.writer:
            raise invalid("this store was opened to read")

    # -- writes

    def put(self, key: bytes, value: bytes, sync: bool = False) -> Status:
        return self._write(key, value, False, sync)

    def remove(self, key: bytes, sync: bool = False) -> Status:
        return self._write(key, b"", True, sync)

    def _write(self, key: bytes, value: bytes, tombstone: bool, sync: bool) -> Status:
        try:
            key = check_key(key)
            self._writes()
        except StoreError as e:
            return e.status
        if self.memtable_bytes >= self.options.memtable_bytes:
            self.flush()
        self.log += encode_record(Record(key, value, 0, tombstone))
        self.memtable[key] = (tombstone, None if tombstone else bytes(value))
        if sync:
            self.sync()
        return Status()

    def sync(self) -> None:
        """Makes single writes durable: what was logged since the last time becomes a log segment."""
        if self.log:
            n = len(self.files.names("wal"))
            self.files.write(f"wal/{n + 1:012d}.wal", bytes(self.log))
            self.log = bytearray()

    def has_taken(self, batch_id: int | str, source: str | None = None) -> bool:
        if source is not None:
            return int(batch_id) <= self.state["sources"].get(source, -1)
        return str(batch_id) in self.taken

    def apply(self, changes: DataFrame, batch_id: int | str | None = None, seq: str = "seq", source: str | None = None) -> bool:
        """Ingests a change log (key, seq, tombstone, value) as one newest layer; a batch id is taken once. With a source,
        batch ids are numbers that grow, and one not above the highest taken of that source was taken. The input is read once;
        an empty or null key fails the whole batch."""
        self._writes()
        if batch_id is not None and self.has_taken(batch_id, source):
            return False
        self.flush()
        key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit(NO_KEY)))
        rows = latest(changes.select(key.alias("key"), F.col(seq).alias("seq"), "tombstone", "value"), mode=Tombstones.EMIT)
        try:
            self._add_layer(rows, batch_id, source)
        except PySparkException as e:
            if NO_KEY in str(e):
                raise invalid(NO_KEY) from None
            raise
        return True

    def flush(self) -> None:
        if self.memtable:
            self.sync()
            segments = list(self.files.names("wal"))
            self._flush_rows()
            for n in segments:
                self.files.delete(f"wal/{n}")

    def _flush_rows(self) -> None:
        rows = [(bytearray(k), t, None if v is None else bytearray(v)) for k, (t, v) in sorted(self.memtable.items())]
        self._add_layer(self.spark.createDataFrame(rows, "key binary, tombstone boolean, value binary"), None)
        self.memtable, self.log = {}, bytearray()
        self.counters["flushes"] += 1

    def _add_layer(self, rows: DataFrame, batch_id: int | str | None, source: str | None = None) -> None:
        state = self._next()
        tables = self._write_tables(rows, 0, state)
        state["levels"][0] = tables + state["levels"][0]
        if source is not None and batch_id is not None:
            state["sources"][source] = int(batch_id)
        elif batch_id is not None:
            state["batches"].append(str(batch_id))
            if len(state["batches"]) > LISTED:
                name = f"batches/{len(state['batch_files']):09d}-{uuid.uuid4().hex[:8]}.json"
                self.files.write(name, json.dumps(state["batches"]).encode())
                state["batch_files"].append(name)
                state["batches"] = []
        if tables or batch_id is not None:
            self._commit(state)
            if batch_id is not None and source is None:
                self.taken.add(str(batch_id))

    def _write_tables(self, rows: DataFrame, level: int, state: dict, size: int | None = None) -> list[dict]:
        """Sorted files of a level, as manifest rows; level 0 writes one id for all its files."""
        id_ = state["next_id"]
        parts = max(1, math.ceil((size or 0) / self.options.target_table_bytes))
        out = rows.select("key", "tombstone", "value", F.lit(level).alias("level"), F.lit(id_).cast("long").alias("table_id"))
        out = out.repartitionByRange(parts, "key") if parts > 1 or level else out.repartitionByRange("key")
        folder = f"tables/{id_:012d}-{uuid.uuid4().hex[:8]}"
        # a filter as large as a file's keys ask for: the best of a range of sizes down to some hundred bytes
        most = 1 << max(20, min(27, (self.options.target_table_bytes // 16).bit_length()))
        filters = {"enabled#key": "true", "adaptive.enabled": "true", "candidates.number#key": str(most.bit_length() - 9), "max.bytes": str(most), "fpp#key": str(0.6185**self.options.probe_bits)}
        out.sortWithinPartitions("key").write.options(**{f"parquet.bloom.filter.{k}": v for k, v in filters.items()}).parquet(f"{self.root}/{folder}")
        self.stop("tables_written")
        found = self._described([f"{folder}/{n}" for n in self.files.names(folder) if n.endswith(".parquet")])
        for k, t in enumerate(found):
            t["id"] = id_ + k if level else id_
        state["next_id"] = id_ + max(1, len(found) if level else 1)
        self.counters["bytes_written"] += sum(t["size"] for t in found)
        return found

    def _described(self, paths: list[str]) -> list[dict]:
        """Manifest rows of files: one row per file comes to the driver, and only keys are read."""
        rows = self.spark.read.schema(LAYER).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else None
        stats = rows.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("table_id").alias("id")).collect() if paths else []
        by = {p.rsplit("/", 1)[1]: p for p in paths}
        out = [{"id": r.id, "path": by[r.f.rsplit("/", 1)[1]], "size": r.s, "entries": r.n, "low": bytes(r.low).hex(), "high": bytes(r.high).hex()} for r in stats if r.n]
        return sorted(out, key=lambda t: t["low"])

    # -- reads

    def _held(self) -> DataFrame | None:
        if not self.memtable:
            return None
        rows = [(bytearray(k), t, None if v is None else bytearray(v), -1, 0) for k, (t, v) in self.memtable.items()]
        return self.spark.createDataFrame(rows, LAYER)

    def layers(self, begin: bytes | None = None, end: bytes | None = None, version: int | None = None, memory: bool = True) -> DataFrame:
        """All rows of a version's tables that may hold keys of [begin, end), of whichever layer."""
        state = self.state
        if version is not None:
            if version not in self.versions():
                raise StoreError(Code.NOT_FOUND, f"no version {version}")
            state = json.loads(self.files.read(f"manifest/{version:012d}.json"))
        tables = [t for level in state["levels"] for t in level if not (begin and t["high"] < begin.hex()) and not (end and t["low"] >= end.hex())]
        return self._opened(tables, memory and version is None, sum(map(len, state["levels"]))).where(in_range("key", begin, end))

    def _opened(self, tables: list[dict], memory: bool = True, of: int | None = None) -> DataFrame:
        """The rows of some tables of a version, and those in memory."""
        self.counters["tables_pruned"] += (self.table_count() if of is None else of) - len(tables)
        self.counters["tables_probed"] += len(tables)
        reader = self.spark.read.schema(LAYER).option("parquet.filter.bloom.enabled", str(self.options.bloom_enabled).lower())
        rows = reader.parquet(*(f"{self.root}/{t['path']}" for t in tables)) if tables else self.spark.createDataFrame([], LAYER)
        held = self._held() if memory else None
        return rows.unionByName(held) if held is not None else rows

    def resolved(self, begin: bytes | None = None, end: bytes | None = None, version: int | None = None, mode: Tombstones = Tombstones.SKIP) -> DataFrame:
        """(key, value), or with tombstones in EMIT mode: memory, then level 0 by id, then deeper levels."""
        rows = self.layers(begin, end, version).withColumn("_rank", -F.col("level"))
        out = latest(rows, seq=["_rank", "table_id"], mode=mode)
        return out.select("key", "value") if mode is Tombstones.SKIP else out.select("key", "tombstone", "value")

    def scan(self, begin: bytes | None = None, end: bytes | None = None, version: int | None = None) -> DataFrame:
        """Live keys of [begin, end) in order; pinned to the version read now or the one asked for."""
        return self.resolved(begin, end, version).orderBy("key")

    def iterator(self, begin: bytes | None = None, end: bytes | None = None):
        """A forward cursor over a scan."""
        for r in self.scan(begin, end).toLocalIterator():
            yield bytes(r.key), bytes(r.value)

    def get(self, key: bytes) -> tuple[Status, bytes | None]:
        try:
            key = check_key(key)
        except StoreError as e:
            return e.status, None
        self.counters["gets"] += 1
        if key in self.memtable:
            tombstone, value = self.memtable[key]
            return (Status(Code.NOT_FOUND), None) if tombstone else (Status(), value)
        probed = self.counters["tables_probed"]
        rows = self.layers(key, key + b"\0", memory=False).where(F.col("key") == F.lit(key)).withColumn("_rank", -F.col("level"))
        answer = latest(rows, seq=["_rank", "table_id"]).select("value")
        found = answer.collect()  # one row at most
        scanned, probed = scanned_rows(answer), self.counters["tables_probed"] - probed
        self.counters["rows_scanned"] += scanned
        self.counters["block_reads"] += -(-scanned // PAGE_ROWS)
        if self.options.bloom_enabled:
            self.counters["bloom_checks"] += probed
            self.counters["bloom_rejects"] += 0 if scanned else probed
        return (Status(), bytes(found[0].value)) if found else (Status(Code.NOT_FOUND), None)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """A row per asked key: key, value and status. Only tables whose key range holds an asked key are opened. Up to LITERALS
        keys reach the scans as literals, so statistics and bloom filters drop row groups; more are joined to the
        rows below the search for the newest ones, by broadcast up to BROADCAST_ROWS."""
        asked = keys.where(F.length("key") > 0).select(F.col("key").cast("binary").alias("key")).distinct()
        some = sorted(bytes(r.key) for r in asked.limit(LITERALS + 1).collect())
        tables = [t for level in self.state["levels"] for t in level]
        if len(some) <= LITERALS:
            hexes = [k.hex() for k in some]
            rows = self._opened([t for t in tables if (i := bisect.bisect_left(hexes, t["low"])) < len(hexes) and hexes[i] <= t["high"]])
            rows = rows.where(F.col("key").isin(some) if some else F.lit(False))
        else:
            n = asked.count()
            ranges = self.spark.createDataFrame([(i, bytearray.fromhex(t["low"]), bytearray.fromhex(t["high"])) for i, t in enumerate(tables)], "at int, low binary, high binary")
            met = held_keys(asked, ranges, "key", "low", "high", "inner").select("at").distinct().collect() if tables else []  # a row per table
            rows = self._opened([tables[r.at] for r in met])
            rows = rows.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, "key", "left_semi")
        live = latest(rows.withColumn("_rank", -F.col("level")), seq=["_rank", "table_id"]).select("key", "value", F.lit(True).alias("_found"))
        status = F.when(F.coalesce(F.length("key") == 0, F.lit(True)), "InvalidArgument").when(F.col("_found"), "OK").otherwise("NotFound")
        return keys.join(live, "key", "left").withColumn("status", status).drop("_found")

    # -- compaction

    def pick(self, force: bool = False) -> tuple[int, list[dict]] | None:
        """The level and tables to merge down: a full level 0, else the shallowest level over its budget (the tables after the
        level's cursor, as many as are over, in one merge; beyond the level's end the next merge begins anew); forced: all of the
        shallowest level with tables."""
        levels, o = self.state["levels"], self.options
        if len({t["id"] for t in levels[0]}) >= o.l0_trigger or (force and levels[0]):
            return 0, levels[0]
        for k, level in enumerate(levels[1:], 1):
            if not level or k >= o.max_levels - 1:
                continue
            if force and any(levels[k + 1 :]):
                return k, level
            excess = sum(t["size"] for t in level) - level_budget(k, o.level_base_bytes, o.level_multiplier)
            if not force and excess > 0:
                after = [t for t in level if t["low"] > self.state["cursors"].get(str(k), "")] or level
                sums = list(accumulate(t["size"] for t in after))
                return k, after[: bisect.bisect_left(sums, excess) + 1]
        return None

    def step(self, force: bool = False) -> bool:
        """One merge into the next level; False if nothing is due."""
        self._writes()
        picked = self.pick(force)
        if not picked:
            return False
        level, inputs = picked
        low, high = min(t["low"] for t in inputs), max(t["high"] for t in inputs)
        below = self.state["levels"][level + 1] if level + 1 < len(self.state["levels"]) else []
        self._merge(inputs + [t for t in below if overlap(t, low, high)], level + 1, {str(level): high})
        return True

    def _merge(self, merged: list[dict], to: int, cursors: dict[str, str]) -> None:
        """Replaces tables of levels up to `to`, all that overlap each other there, by the newest rows of their keys in that level."""
        state = self._next()
        while len(state["levels"]) < to + 1:
            state["levels"].append([])
        rows = self.spark.read.schema(LAYER).parquet(*(f"{self.root}/{t['path']}" for t in merged)).withColumn("_rank", -F.col("level"))
        rows = latest(rows, seq=["_rank", "table_id"], mode=Tombstones.EMIT)
        deeper = [(bytearray.fromhex(t["low"]), bytearray.fromhex(t["high"])) for d in state["levels"][to + 1 :] for t in d]
        if deeper:  # a tombstone goes once no deeper table may hold its key
            ranges = self.spark.createDataFrame(deeper, "min_key binary, max_key binary")
            needless = droppable(rows.where("tombstone").select("key"), ranges)
            rows = rows.join(needless, "key", "left_anti")
        else:
            rows = rows.where("not tombstone")
        size = sum(t["size"] for t in merged)
        made = self._write_tables(rows, to, state, size)
        gone = {t["path"] for t in merged}
        state["levels"] = [[t for t in lv if t["path"] not in gone] for lv in state["levels"]]
        state["levels"][to] = sorted(state["levels"][to] + made, key=lambda t: t["low"])
        state["cursors"].update(cursors)
        self.counters["compactions"] += 1
        self.counters["tables_obsoleted"] += len(merged)
        self.counters["compaction_bytes_read"] += size
        self.counters["compaction_bytes_written"] += sum(t["size"] for t in made)
        self._commit(state)

    def maintain(self) -> int:
        """Steps that are due, until none is."""
        n = 0
        while self.step():
            n += 1
        return n

    def compact(self) -> int:
        """Merges everything into the deepest level with tables, below level 0, in one step; with nothing to do, does nothing."""
        levels = self.state["levels"]
        held = [k for k, level in enumerate(levels) if level]
        if not held or held == [max(1, held[0])]:
            return 0
        self._writes()
        self._merge([t for level in levels for t in level], max(1, held[-1]), {})
        return 1

    # -- accounting

    @property
    def memtable_bytes(self) -> int:
        return sum(len(k) + len(v or b"") + MEMTABLE_ENTRY for k, (_, v) in self.memtable.items())

    def manifest(self) -> DataFrame:
        rows = [(self.state["version"], k, i, t["id"], t["size"], t["entries"], bytearray.fromhex(t["low"]), bytearray.fromhex(t["high"])) for k, level in enumerate(self.state["levels"]) for i, t in enumerate(level)]
        return self.spark.createDataFrame(rows, MANIFEST)

    def tables_at(self, level: int) -> list[int]:
        return [t["id"] for t in self.state["levels"][level]] if level < len(self.state["levels"]) else []

    def level_bytes(self, level: int) -> int:
        return sum(t["size"] for t in self.state["levels"][level]) if level < len(self.state["levels"]) else 0

    def table_count(self) -> int:
        return sum(map(len, self.state["levels"]))

    def level_count(self) -> int:
        return sum(map(bool, self.state["levels"]))

    def total_disk_size(self) -> int:
        return sum(self.level_bytes(k) for k in range(len(self.state["levels"]))) + sum(self.files.names("wal").values())

    def stats(self) -> dict[str, int]:
        """All COUNTERS, what else was counted, and sizes now."""
        return dict.fromkeys(COUNTERS, 0) | dict(self.counters) | {"version": self.state["version"], "tables": self.table_count(), "bytes": self.total_disk_size(), "memtable_entries": len(self.memtable), "memtable_bytes": self.memtable_bytes}

    def amplification(self) -> dict[str, float]:
        """Write: bytes written by flushes and compaction per byte flushed; read: blocks read per get; space: stored bytes
        per byte of live keys and values."""
        live = self.resolved().agg(F.sum(size_of(0, F.col("key"), F.col("value")))).first()[0]
        written = self.counters["bytes_written"]
        return amplification(written - self.counters["compaction_bytes_written"], written, self.counters["block_reads"], self.counters["gets"], self.total_disk_size(), live or 0)

    def reset_stats(self) -> None:
        self.counters.clear()

    def write_many(self, pairs: Iterable[tuple[bytes, bytes | None]]) -> None:
        """put() or, for None, remove() of each pair in order."""
        for k, v in pairs:
            self.remove(k) if v is None else self.put(k, v)
