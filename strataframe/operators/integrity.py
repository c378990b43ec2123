"""Checks and sweeps over logs, tables and manifests, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME = r"^(?:(?P<id>\d+)\.(log|hint|sst|wal)|MANIFEST)(\.tmp)?$"

#: Ranges that are compared with each key; more meet the keys in shuffled buckets.
FEW_RANGES = 256


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Inclusive ranges meet."""
    return ~((a_max < b_min) | (b_max < a_min))


def buckets(tables: DataFrame, rows: int, low: str) -> DataFrame:
    """One row: bounds of buckets of some hundred tables each, as sorted arrays of `_wide` bounds in `_bounds`."""
    step = max(256, rows >> 16)
    drawn = tables.where(F.pmod(F.xxhash64(low), F.lit(step)) == 0).agg(F.array_sort(F.collect_set(low)).alias("_all"))
    wide = F.greatest(F.ceil(F.sqrt(F.size("_all"))), F.lit(1)).cast("int")
    drawn = drawn.select("_all", wide.alias("_wide"))
    chunk = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("_all") - 1, F.lit(0)) / F.col("_wide")).cast("int")), lambda i: F.slice("_all", i * F.col("_wide") + 1, F.col("_wide")))
    return F.broadcast(drawn.select("_wide", chunk.alias("_bounds")))


def bucket(key: Column) -> Column:
    """The number of bounds up to the key, null for a null key: those of the chunks before, then of its own."""
    chunks = F.size(F.filter("_bounds", lambda b: F.get(b, F.lit(0)) <= key))
    own = F.size(F.filter(F.get("_bounds", chunks - 1), lambda b: b <= key))
    return F.when(key.isNotNull(), F.when(chunks > 0, (chunks - 1) * F.col("_wide") + own).otherwise(0))


def dealt(tables: DataFrame, bounds: DataFrame, low: str, high: str) -> DataFrame:
    """A row per bucket that the range covers, its own first one in `_first`."""
    out = tables.crossJoin(bounds).withColumn("_first", bucket(F.col(low))).withColumn("_last", bucket(F.col(high))).drop("_bounds", "_wide")
    return out.withColumn("_bucket", F.explode(F.sequence("_first", F.greatest("_first", "_last")))).drop("_last")


def held_keys(keys: DataFrame, tables: DataFrame, key: str, low: str, high: str, how: str, most: int = FEW_RANGES) -> DataFrame:
    """Keys joined to the ranges that hold them: broadcast up to `most` ranges, else by shuffled buckets."""
    inside = (F.col(key) >= F.col(low)) & (F.col(key) <= F.col(high))
    rows = tables.count()
    if rows <= most:
        return keys.join(F.broadcast(tables), inside, how)
    bounds = buckets(tables, rows, low)
    left = keys.crossJoin(bounds).withColumn("_key_bucket", bucket(F.col(key))).drop("_bounds", "_wide")
    right = dealt(tables.where(F.col(low).isNotNull() & F.col(high).isNotNull()), bounds, low, high).drop("_first")
    out = left.join(right.hint("merge"), (F.col("_key_bucket") == F.col("_bucket")) & inside, how)
    return out.drop("_key_bucket", "_bucket")


def overlap_pairs(tables: DataFrame, level: str = "level", id_: str = "table_id", low: str = "min_key", high: str = "max_key", most: int = FEW_RANGES) -> DataFrame:
    """Pairs (upper, lower) of overlapping tables in neighbouring levels. Up to `most` tables are broadcast; more meet in
    shuffled buckets of keys, each pair in the bucket where the later of the two begins."""
    rows = tables.count()
    meet = overlaps(F.col(f"u.{low}"), F.col(f"u.{high}"), F.col(f"d.{low}"), F.col(f"d.{high}"))
    meet = (F.col(f"u.{level}") + 1 == F.col(f"d.{level}")) & meet
    pair = F.col(f"u.{id_}").alias("upper"), F.col(f"d.{id_}").alias("lower")
    if rows <= most:
        return tables.alias("u").join(F.broadcast(tables).alias("d"), meet).select(*pair)
    some = dealt(tables.select(level, id_, low, high).where(F.col(low).isNotNull() & F.col(high).isNotNull()), buckets(tables, rows, low), low, high)
    own = (F.col("u._bucket") == F.col("d._bucket")) & (F.col("u._bucket") == F.greatest("u._first", "d._first"))
    return some.alias("u").join(some.hint("merge").alias("d"), own & meet).select(*pair)


def disjoint(tables: DataFrame, level: str = "level", id_: str = "table_id", low: str = "min_key", high: str = "max_key") -> DataFrame:
    """Per table: whether it begins after the one before it in its level ends."""
    w = Window.partitionBy(level).orderBy(low, id_)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return tables.withColumn("disjoint", before.isNull() | (before < F.col(low)))


def droppable(keys: DataFrame, deeper: DataFrame, key: str = "key", low: str = "min_key", high: str = "max_key", most: int = FEW_RANGES) -> DataFrame:
    """Tombstones whose key no deeper table may hold; deeper: manifest rows."""
    return held_keys(keys, deeper.select(low, high), key, low, high, "left_anti", most)


def orphans(files: DataFrame, manifest: DataFrame, id_: str = "table_id") -> DataFrame:
    """Files that no manifest row names."""
    return files.join(manifest.select(id_), id_, "left_anti")


def disagreements(files: DataFrame, manifest: DataFrame, id_: str = "table_id", fields: tuple[str, ...] = ("file_size", "entry_count", "min_key", "max_key")) -> DataFrame:
    """Manifest rows whose file is missing or differs in a field."""
    both = manifest.alias("m").join(files.alias("f"), id_, "left")
    wrong = F.lit(False)
    for c in fields:
        wrong = wrong | ~F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    return both.where(wrong).select(id_)


def live_records(log: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("key", "file_id", "offset")) -> DataFrame:
    """Records at which the index points."""
    return log.join(index.select(*keys), list(keys), "left_semi")


def valid_prefix(records: DataFrame, file_id: str = "file_id", offset: str = "offset", ok: Column | str = "ok") -> DataFrame:
    """Records before the first damaged one of their file."""
    good = F.col(ok) if isinstance(ok, str) else ok
    bad = records.groupBy(file_id).agg(F.min(F.when(~good, F.col(offset))).alias("_bad"))
    return records.join(bad, file_id).where(F.col("_bad").isNull() | (F.col(offset) < F.col("_bad"))).drop("_bad")


def crc_ok(body: Column, crc: Column) -> Column:
    return F.crc32(body) == crc


def file_name(name: Column) -> Column:
    """struct(id, kind, temporary) of a store's file name; all null for other names, ids outside 1 to 2**32 - 1 included."""
    digits = F.try_to_number(F.nullif(F.regexp_extract(name, r"^(\d{1,19})\.(?:log|hint|sst|wal)(?:\.tmp)?$", 1), F.lit("")), F.lit("9" * 19)).cast("long")
    kind = F.regexp_extract(name, r"^\d+\.(log|hint|sst|wal)(?:\.tmp)?$", 1)
    ours = (kind != "") & (digits >= 1) & (digits <= 2**32 - 1)
    manifest = name.rlike(r"^MANIFEST(\.tmp)?$")
    return F.struct(F.when(ours, digits).alias("id"), F.when(ours, kind).when(manifest, "manifest").alias("kind"), F.when(ours | manifest, name.endswith(".tmp")).alias("temporary"))


def increasing(entries: DataFrame, table: str = "table_id", key: str = "key", place: str = "place") -> DataFrame:
    """Tables whose keys do not strictly increase with their place."""
    w = Window.partitionBy(table).orderBy(place)
    return entries.withColumn("_before", F.lag(key).over(w)).where(F.col("_before") >= F.col(key)).select(table).distinct()


def candidate_table(keys: DataFrame, level: DataFrame, key: str = "key", low: str = "min_key", high: str = "max_key", most: int = FEW_RANGES) -> DataFrame:
    """For each key, the table of a disjoint level that may hold it; level: manifest rows."""
    return held_keys(keys, level, key, low, high, "left", most)
