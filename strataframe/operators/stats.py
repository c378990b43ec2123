"""Accounting: dead bytes, sizes, levels, amplification, nearest-rank percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataframe.model import Tombstones
from strataframe.operators.resolve import latest

RECORD_HEADER, ENTRY_HEADER, HINT_HEADER, MEMTABLE_ENTRY = 21, 9, 28, 64


def size_of(header: int, key: Column, value: Column | None = None) -> Column:
    """Bytes of a record, table entry or hint entry; no value counts none."""
    out = F.lit(header) + F.length(key)
    return out if value is None else out + F.coalesce(F.length(value), F.lit(0))


def dead(log: DataFrame, key: str = "key", seq: str = "seq", tombstone: Column | str = "tombstone") -> DataFrame:
    """Adds dead: a newer write of the key exists, or the row is a tombstone. The newest seq per key is an
    aggregate joined back, so a key with many versions never meets in one task."""
    gone = F.col(tombstone) if isinstance(tombstone, str) else tombstone
    newest = log.groupBy(key).agg(F.max(seq).alias("_newest"))
    return log.join(newest, key).withColumn("dead", (F.col(seq) < F.col("_newest")) | gone).drop("_newest")


def reclaimable(log: DataFrame, file: Column | str, size: Column, key: str = "key", seq: str = "seq", tombstone: Column | str = "tombstone") -> DataFrame:
    """Dead and total bytes per file."""
    rows = dead(log.withColumn("_file", F.col(file) if isinstance(file, str) else file).withColumn("_size", size), key, seq, tombstone)
    return rows.groupBy(F.col("_file").alias("file_id")).agg(F.sum(F.when(F.col("dead"), F.col("_size")).otherwise(0)).alias("dead_bytes"), F.sum("_size").alias("total_bytes"))


def memtable_size(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq", tombstone: Column | str = "tombstone") -> DataFrame:
    """Entries and approximate bytes of the newest versions, tombstones included."""
    newest = latest(log, key, seq, tombstone, Tombstones.EMIT)
    dead_ = F.col(tombstone) if isinstance(tombstone, str) else tombstone
    held = size_of(MEMTABLE_ENTRY, F.col(key).cast("string"), F.when(~dead_, F.col(value).cast("string")))
    return newest.agg(F.count("*").alias("entries"), F.sum(held).alias("approximate_bytes"))


def levels(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("tables"), F.sum("file_size").alias("bytes"), F.sum("entry_count").alias("entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def percentiles(df: DataFrame, value: str, shares: Sequence[float], buckets: int = 256, few: int = 65_536) -> DataFrame:
    """Nearest-rank percentiles without interpolation: the value at place floor(p * (n - 1)) of the sorted ones, one
    row. For each place, the values are cut at approximate quantiles and counted exactly by bucket (at most `buckets` + 1 rows
    reach the driver); the bucket that holds the place is cut again until it has at most `few` distinct values, and only those are
    sorted. Outliers don't widen a quantile's bucket, so no task sees much of the column, whatever its distribution."""
    v = F.col("v")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    n, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    names = [f"p{f'{p * 100:g}'.replace('.', '')}" for p in shares]
    if not n:
        return df.select(F.col(value)).limit(0).agg(*(F.max(value).alias(c) for c in names))
    out = None
    for name, p in zip(names, shares, strict=True):
        inside, place, held = F.lit(True), int(p * (n - 1)), distinct
        while held > few:
            some = counts.where(inside)
            cuts = sorted(set(some.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 50 * buckets)).first()[0]))
            number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= v))
            sizes = sorted(map(tuple, some.groupBy(number.alias("b")).agg(F.sum("c"), F.count("*")).collect()))
            for b, c, k in sizes:
                if place < c:
                    break
                place -= c
            if k == held:  # nothing was told apart
                break
            held = k
            inside = inside & (v >= F.lit(cuts[b - 1]) if b else F.lit(True)) & (v < F.lit(cuts[b]) if b < len(cuts) else F.lit(True))
        upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("v"))
        found = counts.where(inside).select("v", upto.alias("upto")).where(F.col("upto") > place).agg(F.min("v").alias(name))
        out = found if out is None else out.crossJoin(found)  # one row each
    return out


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("median"))


def amplification(bytes_asked: float, bytes_written: float, blocks_read: float, gets: float, bytes_on_disk: float, bytes_live: float) -> dict[str, float]:
    """Write, read and space amplification; 0 where there is nothing to compare with."""
    ratio = lambda a, b: a / b if b else 0.0
    return {"write": ratio(bytes_written, bytes_asked), "read": ratio(blocks_read, gets), "space": ratio(bytes_on_disk, bytes_live)}
