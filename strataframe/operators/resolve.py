"""Reads: newest version per key, tombstones, layers, ranges, batch lookups.

Two rules hold throughout. The newest version is found before anything but the key is filtered on, so that a filter
on values can't bring an older version back; and a tombstone is an answer, so it takes part until the end.
Keys are pushed to the scans by Catalyst, through the union and the aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.model import Tombstones, invalid

#: A side is broadcast up to so many rows, counted beforehand, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def latest(changes: DataFrame, key: str | Sequence[str] = "key", seq: str | Sequence[str] = "seq", tombstone: Column | str = "tombstone", mode: Tombstones = Tombstones.SKIP) -> DataFrame:
    """The newest row of each key by seq (unique per key), without removed keys unless mode is EMIT. One
    aggregate with partial sums: each task sends one row per key, whatever a key's number of versions."""
    keys = [key] if isinstance(key, str) else list(key)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in changes.columns if c not in keys]
    dead = F.col(tombstone) if isinstance(tombstone, str) else tombstone
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest, dead.alias("_dead")), F.struct(*seqs)).alias("_new"))
    if mode is Tombstones.SKIP:
        newest = newest.where("not _new._dead")
    return newest.select(*(F.col(c) if c in keys else F.col("_new")[c].alias(c) for c in changes.columns))


def in_range(key: Column | str, begin=None, end=None) -> Column:
    """[begin, end); a None or empty bound is open."""
    key = F.col(key) if isinstance(key, str) else key
    out = F.lit(True)
    if begin:
        out = out & (key >= F.lit(begin))
    if end:
        out = out & (key < F.lit(end))
    return out


def scan(changes: DataFrame, begin=None, end=None, key: str = "key", seq: str | Sequence[str] = "seq", tombstone: Column | str = "tombstone") -> DataFrame:
    """Live keys of a half-open range in ascending order; an empty range has no rows and is no error."""
    return latest(changes.where(in_range(key, begin, end)), key, seq, tombstone).orderBy(key)


def point(changes: DataFrame, key_value, key: str = "key", seq: str | Sequence[str] = "seq", tombstone: Column | str = "tombstone") -> DataFrame:
    """The newest live row of one key, or none."""
    if key_value in (b"", ""):
        raise invalid("a key is not empty")
    return latest(changes.where(F.col(key) == F.lit(key_value)), key, seq, tombstone)


def layered(layers: Sequence[DataFrame], key: str = "key", mode: Tombstones = Tombstones.SKIP, tombstone: str = "tombstone") -> DataFrame:
    """Merge of layers, newest first; each has a key once."""
    ranked = [d.withColumn("_rank", F.lit(-i)) for i, d in enumerate(layers)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), ranked)
    return latest(both, key, "_rank", tombstone, mode).drop("_rank")


def lookup(layer: DataFrame, keys: DataFrame, key: str = "key", tombstone: str = "tombstone") -> DataFrame:
    """Three-way answer of one layer for each key: NotPresent, Deleted or Found. Deleted ends a search."""
    answer = F.when(F.col(tombstone).isNull(), "NotPresent").when(F.col(tombstone), "Deleted").otherwise("Found")
    return keys.join(layer, key, "left").withColumn("lookup", answer)


def multi_get(live: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """A row per asked key with status OK or NotFound; empty and null keys are InvalidArgument. A small key list is
    broadcast and prunes the store, a large one is joined by a shuffle."""
    asked = keys.select(key).distinct()
    found = live.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, key, "left_semi").withColumn("_found", F.lit(True))
    bad = F.col(key).isNull() | (F.length(key) == 0)
    status = F.when(bad, "InvalidArgument").when(F.col("_found"), "OK").otherwise("NotFound")
    return keys.join(found, key, "left").withColumn("status", status).drop("_found")


def as_of(changes: DataFrame, seq_value, seq: str = "seq") -> DataFrame:
    """The change log as it was when seq_value was its newest write."""
    return changes.where(F.col(seq) <= F.lit(seq_value))
