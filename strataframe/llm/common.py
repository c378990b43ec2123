"""Shared folder, words and hashes used by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
BYTE_WORDS = re.compile(WORD.encode())
#: The end-of-text id that follows every document.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_root(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a local
    folder of its own; a cluster gets an error, as a local folder there is another one on every node."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = f"file://{tempfile.mkdtemp(prefix='strataframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/strataframe/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote within it, in this thread or task, and have not deleted; so whatever reads
    those tables is to be written before. Outside of any such block, tables stay until their folder is cleaned."""
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in paths:
            delete(spark, path)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing. Its shuffle
    files go at once; the table stays until discard() or, unless it is to be kept, the end of the block of tables() it was written in."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if not keep and (paths := _scope.get()) is not None:
        paths.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._written_at)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows and bytes, so that very long texts don't become Python objects together. An
    empty batch passes. Spark bounds what it sends at once by spark.sql.execution.arrow.maxBytesPerBatch (64 MiB)."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column, modulus: int) -> Column:
    """crc32(key as text) mod modulus; null for a null key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run: runs([2, 3]) is [0, 1, 0, 1, 2]."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Memo(dict):
    """A dict of at most `limit` keys that is emptied when full; misses are filled a batch at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def missing(self, keys: Iterable) -> list:
        keys = set(keys)
        new = keys.difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = keys
        return list(new)


#: Bins that an interval is cut into per round of at_places().
BINS = 256


def at_places(values: DataFrame, keys: list[str], places: Callable[[int], list[float]], least: int = 1) -> dict[tuple, list[float]]:
    """Exact order statistics of the finite column `v` per group: its values at the places (from 0) that `places` gives for the
    group's number of rows; a place between two rows interpolates. Groups of fewer than `least` rows are left out. All rows count, and none leaves its task: each round cuts the
    intervals that hold a place into bins, counts them, and keeps the bins that hold it with their least and largest value."""
    agg = F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    want: dict[tuple, list[float]] = {}
    found: dict[tuple, float] = {}
    left: list[tuple] = []

    def look(group: tuple, below: int, n: int, lo: float, hi: float, ranks: set[int]) -> None:
        found.update({(group, r): lo for r in ranks if r == below or lo == hi})
        found.update({(group, r): hi for r in ranks if r == below + n - 1})
        rest = {r for r in ranks if (group, r) not in found}
        if rest:
            left.append((group, below, lo, hi, rest))

    for r in values.groupBy(*keys).agg(*agg).where(F.col("n") >= max(1, least)).collect():
        group = tuple(r[k] for k in keys)
        want[group] = [min(max(0.0, p), r.n - 1.0) for p in places(r.n)]
        look(group, 0, r.n, r.lo, r.hi, {min(int(p) + i, r.n - 1) for p in want[group] for i in (0, 1)})
    while left:
        asked, left = left, []
        schema = ", ".join(f"_{k} {values.schema[k].dataType.simpleString()}" for k in keys)
        parts = values.sparkSession.createDataFrame([(*group, i, lo, hi) for i, (group, _, lo, hi, _) in enumerate(asked)], f"{schema}, part int, first double, last double")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        inside = values.join(F.broadcast(parts), [*same, F.col("v").between(F.col("first"), F.col("last"))])
        bin_ = F.least(F.floor((F.col("v") - F.col("first")) / (F.col("last") - F.col("first")) * BINS), F.lit(BINS - 1))
        got = inside.groupBy("part", bin_.alias("bin")).agg(*agg).toArrow().sort_by([("part", "ascending"), ("bin", "ascending")])
        part, n, lo, hi = (got.column(c).to_numpy() for c in ("part", "n", "lo", "hi"))
        edges = np.searchsorted(part, np.arange(len(asked) + 1))
        for (group, below, _, _, ranks), a, b in zip(asked, edges, edges[1:], strict=False):
            ends = below + np.cumsum(n[a:b])
            by: dict[int, set] = {}
            for r in ranks:
                by.setdefault(int(np.searchsorted(ends, r, "right")), set()).add(r)
            for k, some in by.items():
                look(group, int(ends[k] - n[a + k]), int(n[a + k]), float(lo[a + k]), float(hi[a + k]), some)

    def at(group: tuple, place: float) -> float:
        low, high, t = found[group, int(place)], found[group, math.ceil(place)], place - int(place)
        return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)

    return {group: [at(group, p) for p in x] for group, x in want.items()}
