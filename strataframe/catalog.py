"""The registered queries of the key-value engine and their SQL.

The driver's tables stand for stores: `events` is a change log (key user_id, order event_id, a tombstone where event_type is
'error'), `customer` a store by name, `orders` a layered one (key o_custkey, layer o_orderkey % 4, the highest newest).
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataframe.functions import scalars
from strataframe.model import Code, Options, Status, Tombstones
from strataframe.operators import integrity, resolve, stats
from strataframe.plans.layered import LayeredStore, scanned_rows
from strataframe.plans.logstore import LogStore
from strataframe.plans.memory import LockedStore, MemoryStore
from strataframe.plans.shared import shared_path
from strataframe.sources import formats, logs, wire
from strataframe.sources.reports import read_report, write_report
from strataframe.streaming.ingest import ingest, latest_state, source_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DEAD = "event_type = 'error'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("tombstone", F.expr(DEAD))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as bytes, as stores take them."""
    ev = events(spark, sf_dir)
    return ev.select(F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.col("event_id").alias("seq"), "tombstone", F.when(~F.col("tombstone"), F.encode("props", "UTF-8")).alias("value"))


def text(key: str = "key", value: str = "value") -> list[Column]:
    return [F.decode(key, "UTF-8").cast("long").alias("user_id"), F.decode(value, "UTF-8").alias("props")]


NEWEST = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY user_id"
HALF = NEWEST.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))")
LIVE_PROPS = f"SELECT user_id, props FROM ({NEWEST}) WHERE NOT ({DEAD})"


@query(f"SELECT user_id, value FROM ({NEWEST}) WHERE NOT ({DEAD})")
def lww_live(spark, sf_dir):
    return resolve.latest(events(spark, sf_dir), "user_id", "event_id").select("user_id", "value")


@query(f"SELECT user_id, event_id, {DEAD} AS tombstone FROM ({NEWEST})")
def lww_emit(spark, sf_dir):
    return resolve.latest(events(spark, sf_dir), "user_id", "event_id", mode=Tombstones.EMIT).select("user_id", "event_id", "tombstone")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
def point_get(spark, sf_dir):
    store = table(spark, sf_dir, "customer").withColumn("tombstone", F.lit(False))
    return resolve.point(store, "Customer#000000042", "c_name", "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT user_id, value FROM ({NEWEST}) WHERE user_id = 7 AND NOT ({DEAD})")
def point_get_resolved(spark, sf_dir):
    return resolve.point(events(spark, sf_dir), 7, "user_id", "event_id").select("user_id", "value")


@query(f"""SELECT k.user_id, CASE WHEN n.user_id IS NULL THEN 'NotFound' ELSE 'OK' END AS status, n.value
FROM (SELECT DISTINCT o_custkey AS user_id FROM orders) k LEFT JOIN (SELECT * FROM ({NEWEST}) WHERE NOT ({DEAD})) n USING (user_id)""")
def multi_get_status(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return resolve.multi_get(lww_live(spark, sf_dir), keys, "user_id").select("user_id", "status", "value")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200' ORDER BY c_name")
def range_scan(spark, sf_dir):
    store = table(spark, sf_dir, "customer").withColumn("tombstone", F.lit(False))
    return resolve.scan(store, "Customer#000000100", "Customer#000000200", "c_name", "c_custkey").select("c_name", "c_custkey")


@query("SELECT count(*) FILTER (c_name >= 'Xray' AND c_name < 'Zulu') AS keys, 'OK' AS status FROM customer")
def empty_range(spark, sf_dir):
    store = table(spark, sf_dir, "customer").withColumn("tombstone", F.lit(False))
    return resolve.scan(store, "Xray", "Zulu", "c_name", "c_custkey").agg(F.count("*").alias("keys"), F.lit("OK").alias("status"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey DESC) AS r FROM orders)
WHERE r = 1 AND o_orderstatus <> 'F'""")
def layered_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("tombstone", F.col("o_orderstatus") == "F")
    layers = [resolve.latest(orders.where(F.col("o_orderkey") % 4 == k), "o_custkey", "o_orderkey", mode=Tombstones.EMIT) for k in (3, 2, 1, 0)]
    return resolve.layered(layers, "o_custkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT k.o_custkey, CASE WHEN l.o_custkey IS NULL THEN 'NotPresent' WHEN s = 'F' THEN 'Deleted' ELSE 'Found' END AS lookup
FROM (SELECT DISTINCT o_custkey FROM orders) k LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 4 = 3 GROUP BY o_custkey) l USING (o_custkey)""")
def layer_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("tombstone", F.col("o_orderstatus") == "F")
    layer = resolve.latest(orders.where(F.col("o_orderkey") % 4 == 3), "o_custkey", "o_orderkey", mode=Tombstones.EMIT)
    return resolve.lookup(layer, orders.select("o_custkey").distinct(), "o_custkey").select("o_custkey", "lookup")


def half(spark: SparkSession, sf_dir: str) -> int:
    """A version of the log: half of its writes."""
    return events(spark, sf_dir).agg(F.max("event_id")).first()[0] // 2


@query(f"SELECT user_id, value FROM ({HALF}) WHERE NOT ({DEAD})")
def snapshot_read(spark, sf_dir):
    return resolve.latest(resolve.as_of(events(spark, sf_dir), half(spark, sf_dir), "event_id"), "user_id", "event_id").select("user_id", "value")


@query(f"""SELECT event_id // 256 AS file_id, CAST(sum(CASE WHEN nxt IS NOT NULL OR {DEAD} THEN size ELSE 0 END) AS BIGINT) AS dead_bytes, CAST(sum(size) AS BIGINT) AS total_bytes FROM
(SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, 21 + length(CAST(user_id AS VARCHAR)) + CASE WHEN {DEAD} THEN 0 ELSE length(props) END AS size FROM events) GROUP BY 1""")
def dead_bytes(spark, sf_dir):
    size = stats.size_of(stats.RECORD_HEADER, F.col("user_id").cast("string"), F.when(~F.col("tombstone"), F.col("props")))
    return stats.reclaimable(events(spark, sf_dir), F.floor(F.col("event_id") / 256), size, "user_id", "event_id")


@query(f"SELECT count(*) AS entries, CAST(sum(64 + length(CAST(user_id AS VARCHAR)) + CASE WHEN {DEAD} THEN 0 ELSE length(props) END) AS BIGINT) AS approximate_bytes FROM ({NEWEST})")
def memtable_bytes(spark, sf_dir):
    return stats.memtable_size(events(spark, sf_dir), "user_id", "props", "event_id")


def as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest-like rows over orders: level o_custkey % 3, table by ranges of order keys."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy((F.col("o_custkey") % 3).cast("int").alias("level"), F.floor(F.col("o_orderkey") / 500).alias("slot")).agg(F.count("*").alias("entry_count"), F.sum(F.lit(9) + F.length("o_orderpriority")).alias("file_size"), F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key")).withColumn("table_id", F.col("slot") * 3 + F.col("level"))


TABLES = "SELECT CAST(o_custkey % 3 AS INT) AS level, o_orderkey // 500 AS slot, count(*) AS entry_count, CAST(sum(9 + length(o_orderpriority)) AS BIGINT) AS file_size, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, (o_orderkey // 500) * 3 + o_custkey % 3 AS table_id FROM orders GROUP BY o_custkey % 3, o_orderkey // 500"


@query(f"SELECT level, count(*) AS tables, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(entry_count) AS BIGINT) AS entries, min(min_key) AS min_key, max(max_key) AS max_key FROM ({TABLES}) GROUP BY level")
def level_stats(spark, sf_dir):
    return stats.levels(as_tables(spark, sf_dir))


@query(f"WITH t AS ({TABLES}) SELECT u.table_id AS upper, d.table_id AS lower FROM t u JOIN t d ON u.level + 1 = d.level AND NOT (u.max_key < d.min_key OR d.max_key < u.min_key)")
def overlap_pairs(spark, sf_dir):
    return integrity.overlap_pairs(as_tables(spark, sf_dir))


@query(f"SELECT level, table_id, coalesce(max(max_key) OVER (PARTITION BY level ORDER BY min_key, table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < min_key, true) AS disjoint FROM ({TABLES})")
def disjoint_check(spark, sf_dir):
    return integrity.disjoint(as_tables(spark, sf_dir)).select("level", "table_id", "disjoint")


@query(f"WITH t AS ({TABLES}) SELECT l.l_orderkey, t.table_id FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN t ON t.level = 1 AND l.l_orderkey BETWEEN t.min_key AND t.max_key")
def candidate_table(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    level = as_tables(spark, sf_dir).where("level = 1").select("table_id", "min_key", "max_key")
    return integrity.candidate_table(keys, level, "l_orderkey").select("l_orderkey", "table_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 16 = 0)")
def orphan_sweep(spark, sf_dir):
    """Files (customers) that no manifest row (each 16th order) names."""
    named = table(spark, sf_dir, "orders").where("o_orderkey % 16 = 0").withColumnRenamed("o_custkey", "c_custkey")
    return integrity.orphans(table(spark, sf_dir, "customer").select("c_custkey"), named, "c_custkey")


@query("SELECT DISTINCT o_custkey AS file_id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 1")
def orphan_hints(spark, sf_dir):
    """Hint files whose log is gone, by the ids in their names."""
    orders = table(spark, sf_dir, "orders")
    named = lambda kind, rows: rows.select(integrity.file_name(scalars.file_name_column(F.col("o_custkey"), kind)).getField("id").alias("file_id")).where("file_id is not null").distinct()
    return integrity.orphans(named("hint", orders.where("o_orderkey % 2 = 0")), named("log", orders.where("o_orderkey % 8 = 1")), "file_id")


@query(f"WITH t AS ({TABLES}) SELECT table_id FROM t WHERE entry_count % 2 = 1 OR slot = 1")
def manifest_agreement(spark, sf_dir):
    tables = as_tables(spark, sf_dir)
    files = tables.where("slot <> 1").withColumn("entry_count", F.col("entry_count") - F.col("entry_count") % 2)
    return integrity.disagreements(files, tables)


@query(f"SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM ({NEWEST}) n WHERE n.user_id = e.user_id AND n.event_id = e.event_id AND NOT ({DEAD.replace('event_type', 'n.event_type')}))")
def live_semi(spark, sf_dir):
    ev = events(spark, sf_dir)
    index = resolve.latest(ev, "user_id", "event_id")
    return integrity.live_records(ev, index, ("user_id", "event_id")).select("event_id")


@query("WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) SELECT max(v) FILTER (i = CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1) AS p50, max(v) FILTER (i = CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1) AS p99, max(v) FILTER (i = CAST(floor(0.999 * (n - 1)) AS BIGINT) + 1) AS p999 FROM r")
def nearest_rank_pctl(spark, sf_dir):
    return stats.percentiles(table(spark, sf_dir, "orders"), "o_totalprice", (0.5, 0.99, 0.999))


@query("SELECT o_orderstatus, median(o_totalprice) AS median FROM orders GROUP BY o_orderstatus")
def median_price(spark, sf_dir):
    return stats.median(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])


@query(f"WITH t AS ({TABLES}) SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM t WHERE level = 2 AND l_orderkey BETWEEN min_key AND max_key)")
def tombstone_droppable(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey").distinct()
    return integrity.droppable(keys, as_tables(spark, sf_dir).where("level = 2"), "l_orderkey")


NAMES = "CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.log' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.sst.tmp' WHEN 2 THEN 'MANIFEST' WHEN 3 THEN '0.wal' WHEN 4 THEN '4294967296.hint' ELSE 'x' || CAST(o_orderkey AS VARCHAR) || '.log' END"


@query(f"""SELECT o_orderkey, CASE WHEN own THEN CAST(digits AS BIGINT) END AS id, CASE WHEN own THEN regexp_extract(name, '\\.(log|hint|sst|wal)', 1) WHEN mani THEN 'manifest' END AS kind, CASE WHEN own OR mani THEN ends_with(name, '.tmp') END AS temporary FROM
(SELECT *, regexp_matches(name, '^MANIFEST(\\.tmp)?$') AS mani, coalesce(TRY_CAST(nullif(digits, '') AS BIGINT) BETWEEN 1 AND 4294967295, false) AS own FROM (SELECT o_orderkey, name, regexp_extract(name, '^(\\d+)\\.(log|hint|sst|wal)(\\.tmp)?$', 1) AS digits FROM (SELECT o_orderkey, {NAMES} AS name FROM orders)))""")
def file_name_parse(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NAMES.replace("VARCHAR", "STRING")).alias("name"))
    return names.withColumn("f", integrity.file_name(F.col("name"))).select("o_orderkey", "f.id", "f.kind", "f.temporary")


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000000 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '.sst' AS name, printf('key_%012d', o_orderkey * 2) AS present, printf('key_%012d', o_orderkey * 2 + 1) AS absent FROM orders")
def key_names(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.file_name_column(k, "sst").alias("name"), scalars.present_key(k).alias("present"), scalars.absent_key(k).alias("absent"))


@query("SELECT DISTINCT l_orderkey % 7 AS file_id FROM lineitem WHERE l_orderkey % 7 IN (2, 5)")
def increasing_keys(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("file_id"), "l_orderkey").distinct()
    place = F.when(F.col("file_id").isin(2, 5), -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return integrity.increasing(items.withColumn("place", place), "file_id", "l_orderkey")


@query("""WITH r AS (SELECT event_id // 512 AS file_id, event_id % 512 AS place, event_id, event_id % 512 <> 300 AS ok FROM events), b AS (SELECT file_id, min(place) FILTER (NOT ok) AS bad FROM r GROUP BY file_id)
SELECT event_id FROM r JOIN b USING (file_id) WHERE bad IS NULL OR place < bad""")
def valid_prefix(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 512).alias("file_id"), (F.col("event_id") % 512).alias("offset"), "event_id")
    return integrity.valid_prefix(ev.withColumn("ok", F.col("offset") != 300)).select("event_id")


@query(f"SELECT user_id, event_id FROM ({NEWEST}) EXCEPT SELECT user_id, event_id FROM ({HALF})")
def index_difference(spark, sf_dir):
    now = lww_emit(spark, sf_dir).select("user_id", "event_id")
    then = resolve.latest(resolve.as_of(events(spark, sf_dir), half(spark, sf_dir), "event_id"), "user_id", "event_id", mode=Tombstones.EMIT).select("user_id", "event_id")
    return now.exceptAll(then)


@query(f"SELECT user_id, value FROM ({NEWEST}) WHERE NOT ({DEAD})")
def streaming_lww(spark, sf_dir):
    """The latest state of the events as a stream, taken when all of them have arrived."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    state = latest_state(stream, "user_id", "event_id", F.expr(DEAD), ["value"])
    out = shared_path(spark, "streaming-lww")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/state")


@query(LIVE_PROPS)
def layered_store(spark, sf_dir):
    """Four batches into a layered store, compaction on the way, and a scan."""
    store = LayeredStore(spark, shared_path(spark, "layered-store"), Options(l0_trigger=3))
    for k, batch in enumerate(batches(spark, sf_dir)):
        store.apply(batch, k)
        store.maintain()
    return store.resolved().select(*text())


def batches(spark: SparkSession, sf_dir: str, parts: int = 4) -> list[DataFrame]:
    """The change log in batches in the order of writes."""
    log = changelog(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] + 1
    return [log.where((F.col("seq") >= top * k // parts) & (F.col("seq") < top * (k + 1) // parts)) for k in range(parts)]


@query(LIVE_PROPS)
def log_store(spark, sf_dir):
    """Four appends into a log store, a file each, compaction, and its live keys."""
    return compacted_log(spark, sf_dir).live().select(*text())


def compacted_log(spark: SparkSession, sf_dir: str) -> LogStore:
    store = LogStore(spark, shared_path(spark, "log-store"), Options(max_file_bytes=1))
    for batch in batches(spark, sf_dir):
        store.append(batch)
    store.compact()
    return store


@query(LIVE_PROPS)
def stream_ingest(spark, sf_dir):
    """The events as a stream into a layered store."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("tombstone", F.expr(DEAD))
    stream = stream.select(F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.col("event_id").alias("seq"), "tombstone", F.when(~F.col("tombstone"), F.encode("props", "UTF-8")).alias("value"))
    store = LayeredStore(spark, shared_path(spark, "stream-store"))
    ingest(stream, store, shared_path(spark, "stream-checkpoint")).awaitTermination()
    return store.resolved().select(*text())


@query(f"""SELECT CAST(count(*) AS BIGINT) AS log_records, CAST(count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM ({LIVE_PROPS}))) AS BIGINT) AS live_keys,
round(sum(21 + length(CAST(user_id AS VARCHAR)) + CASE WHEN {DEAD} THEN 0 ELSE length(props) END) / (SELECT sum(21 + length(CAST(user_id AS VARCHAR)) + length(props)) FROM ({LIVE_PROPS})), 6) AS space_amplification FROM events""")
def space_amplification(spark, sf_dir):
    ev = events(spark, sf_dir)
    size = stats.size_of(stats.RECORD_HEADER, F.col("user_id").cast("string"), F.when(~F.col("tombstone"), F.col("props")))
    none = F.lit(0).cast("long")
    live = resolve.latest(ev, "user_id", "event_id").agg(none.alias("records"), none.alias("all"), F.count("*").alias("keys"), F.sum(size).alias("live"))
    whole = ev.agg(F.count("*").alias("records"), F.sum(size).alias("all"), none.alias("keys"), none.alias("live"))
    both = whole.unionByName(live).agg(*(F.sum(c).alias(c) for c in ("records", "all", "keys", "live")))
    return both.select(F.col("records").alias("log_records"), F.col("keys").alias("live_keys"), F.round(F.col("all") / F.col("live"), 6).alias("space_amplification"))


def through(df: DataFrame, f: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows of each batch through a function on whole batches, as a codec takes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(f(batch.to_dict("records")), columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


@query(f"SELECT user_id, event_id, {DEAD} AS tombstone, CASE WHEN NOT ({DEAD}) THEN props END AS props FROM events")
def record_codec(spark, sf_dir):
    """The change log through framed records and back."""

    def f(rows: list[dict]) -> list[tuple]:
        log = b"".join(formats.encode_record(formats.Record(bytes(r["key"]), bytes(r["value"] or b""), r["seq"], r["tombstone"])) for r in rows)
        return [(int(r.key), r.ts, r.tombstone, None if r.tombstone else r.value.decode()) for _, _, r in formats.scan_records(log)]

    return through(changelog(spark, sf_dir), f, "user_id long, event_id long, tombstone boolean, props string")


@query("SELECT c_custkey, c_name, 'Found' AS lookup FROM customer")
def table_codec(spark, sf_dir):
    """Customers through sorted table files and back, each looked up by filter and block."""

    def f(rows: list[dict]) -> list[tuple]:
        by = {r["c_name"].encode(): str(r["c_custkey"]).encode() for r in rows}
        table_ = formats.Table(formats.encode_table([formats.Entry(k, v) for k, v in sorted(by.items())], 512))
        absent = sum(table_.get(k + b"~") is not None for k in by)
        return [(int(e.value), e.key.decode(), "Found" if table_.get(e.key) == e and not absent else "NotPresent") for e in table_]

    return through(table(spark, sf_dir, "customer"), f, "c_custkey long, c_name string, lookup string")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'DELETE' END AS op, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS value FROM orders")
def wire_codec(spark, sf_dir):
    """Requests for order keys through frames and back."""

    def f(rows: list[dict]) -> list[tuple]:
        ops = (wire.GET, wire.PUT, wire.DELETE)
        sent = b"".join(wire.frame(wire.encode_request(wire.Request(ops[r["o_orderkey"] % 3], str(r["o_orderkey"]).encode(), r["o_orderpriority"].encode()))) for r in rows)
        got = [wire.decode_request(p) for p in wire.Frames().feed(sent)]
        return [(int(r.key), ("GET", "PUT", "DELETE")[r.op - 1], r.value.decode()) for r in got]

    return through(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), f, "o_orderkey long, op string, value string")


@query(f"WITH t AS ({TABLES}) SELECT level, CAST(level = 0 AS BOOLEAN) AS overlapping, CAST(10485760 * 10 ** (level - 1) AS BIGINT) * CAST(level > 0 AS INT) AS budget, CAST(sum(file_size) AS BIGINT) AS bytes FROM t GROUP BY level")
def level_budgets(spark, sf_dir):
    budgets = F.create_map(*(F.lit(x) for k in range(7) for x in (k, scalars.level_budget(k))))
    rows = as_tables(spark, sf_dir).groupBy("level").agg(F.sum("file_size").alias("bytes"))
    return rows.select("level", (F.col("level") == 0).alias("overlapping"), budgets[F.col("level")].cast("long").alias("budget"), "bytes")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(max(o_orderkey) AS BIGINT) AS newest FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 GROUP BY o_orderstatus")
def range_summary(spark, sf_dir):
    """A range scan summed up; beyond what the model itself offers."""
    orders = table(spark, sf_dir, "orders").withColumn("tombstone", F.lit(False))
    return resolve.latest(orders.where(resolve.in_range("o_orderkey", 100, 900)), "o_orderkey", "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


BYTES = "list_transform(range(0, CAST(strlen({0}) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl"
CRC = "xor(list_reduce(" + BYTES + ", lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
FNV = "list_reduce(list_transform(" + BYTES + ", lambda b: CAST(b AS UBIGINT)), lambda h, b: CAST(CAST(xor(h, b) AS UHUGEINT) * 1099511628211 % 18446744073709551616 AS UBIGINT), CAST(14695981039346656037 AS UBIGINT))"
SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE CAST({0} AS HUGEINT) END AS BIGINT)"


@query(f"WITH t AS ({CRC_TABLE}) SELECT event_id, {CRC.format('props')} AS crc, event_id % 16 <> 3 AS ok FROM events, t")
def crc_check(spark, sf_dir):
    """Checksums of the values, and a check of bodies of which each sixteenth is damaged."""
    ev = table(spark, sf_dir, "events").select("event_id", "props", F.crc32("props").alias("crc"))
    body = F.when(F.col("event_id") % 16 == 3, F.concat("props", F.lit("!"))).otherwise(F.col("props"))
    return ev.select("event_id", "crc", integrity.crc_ok(body, F.col("crc")).alias("ok"))


@query(f"SELECT key, {SIGNED.format('h')} AS hash FROM (SELECT key, {FNV.format('key')} AS h FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events))")
def fnv_hashes(spark, sf_dir):
    """The 64-bit hash that filters use, of the keys."""
    return changelog(spark, sf_dir).select(F.decode("key", "UTF-8").alias("key")).distinct().select("key", scalars.fnv1a_column(F.encode("key", "UTF-8")).alias("hash"))


@query(f"""SELECT place, CAST(count(*) AS BIGINT) AS keys FROM (SELECT unnest(list_transform(range(7), lambda i: CAST((h % 4294967296 + i * d % 4294967296) % 4294967296 % 16384 AS BIGINT))) AS place FROM
(SELECT CAST(h AS HUGEINT) AS h, CASE WHEN h // 4294967296 = 0 THEN CAST(2654435769 AS HUGEINT) ELSE CAST(h // 4294967296 AS HUGEINT) END AS d FROM (SELECT {FNV.format('c_name')} AS h FROM customer))) GROUP BY place""")
def bloom_bits(spark, sf_dir):
    """The bits that a filter of all customers' names sets, and how many probes set each."""
    places = scalars.probes_column(F.col("h"), scalars.probe_count(10), 1 << 14)
    return table(spark, sf_dir, "customer").select(scalars.fnv1a_column(F.encode("c_name", "UTF-8")).alias("h")).select(F.explode(places).alias("place")).groupBy("place").agg(F.count("*").alias("keys"))


@query("SELECT p_partkey, p_size * 1048576 // 116 AS keys, 16 * (p_size * 1048576 // 116) AS key_bytes FROM part")
def dataset_sizes(spark, sf_dir):
    """Keys of 16 bytes with values of 100 that make so many megabytes."""
    keys = scalars.keys_for_column(F.col("p_size"), 100)
    return table(spark, sf_dir, "part").select("p_partkey", keys.alias("keys"), (16 * keys).alias("key_bytes"))


# -- the layered store from end to end


def loaded(spark: SparkSession, sf_dir: str, label: str, options: Options = Options(), maintain: bool = False) -> LayeredStore:
    store = LayeredStore(spark, shared_path(spark, label), options)
    for k, batch in enumerate(batches(spark, sf_dir)):
        store.apply(batch, k)
        if maintain:
            store.maintain()
    return store


FIRST_HALF = f"SELECT user_id, props FROM ({NEWEST.replace('FROM events', 'FROM (SELECT * FROM events WHERE event_id < (SELECT (max(event_id) + 1) * 2 // 4 FROM events))')}) WHERE NOT ({DEAD})"
SMALL = Options(l0_trigger=2, level_base_bytes=20_000, level_multiplier=2, target_table_bytes=8_000)


@query(FIRST_HALF)
def version_pin(spark, sf_dir):
    """The store as its second version has it, read after the fourth."""
    return loaded(spark, sf_dir, "pin-store").scan(version=2).select(*text())


@query(FIRST_HALF)
def pinned_reader(spark, sf_dir):
    """A scan that was begun before compaction replaced all of its tables, read after it."""
    first, *rest = [batches(spark, sf_dir)[:2], *batches(spark, sf_dir)[2:]]
    store = LayeredStore(spark, shared_path(spark, "reader-store"), Options(l0_trigger=2))
    for batch in first:
        store.apply(batch)
    before = LayeredStore(spark, store.root, writer=False).scan()
    for batch in rest:
        store.apply(batch)
        store.maintain()
    store.compact()
    store.vacuum()
    return before.select(*text())


@query(f"""SELECT k.user_id, CASE WHEN n.user_id IS NULL THEN 'NotFound' ELSE 'OK' END AS status, n.props
FROM (SELECT DISTINCT o_custkey AS user_id FROM orders) k LEFT JOIN ({LIVE_PROPS}) n USING (user_id)""")
def store_multi_get(spark, sf_dir):
    """A batch get from tables that ranges and filters prune; keys are the orders' customers, most of them absent."""
    keys = table(spark, sf_dir, "orders").select(F.encode(F.col("o_custkey").cast("string"), "UTF-8").alias("key")).distinct()
    return loaded(spark, sf_dir, "get-store", maintain=True).multi_get(keys).select(*text(), "status")


@query("SELECT 'absent' AS asked, count(*) AS keys, CAST(0 AS BIGINT) AS found, CAST(0 AS BIGINT) AS rows_scanned FROM region UNION ALL SELECT 'outside', count(*), 0, 0 FROM nation")
def absent_keys(spark, sf_dir):
    """Batch gets of keys that filters or ranges rule out: no row leaves a scan."""
    store = LayeredStore(spark, shared_path(spark, "absent-store"))
    names = table(spark, sf_dir, "customer").select(F.encode("c_name", "UTF-8").alias("key"), F.col("c_custkey").alias("seq"), F.lit(False).alias("tombstone"), F.encode("c_mktsegment", "UTF-8").alias("value"))
    store.apply(names)
    out = []
    for asked, keys in (("absent", table(spark, sf_dir, "region").select(F.format_string("Customer#0000000%02d-none", "r_regionkey"))), ("outside", table(spark, sf_dir, "nation").select(F.concat(F.lit("zz"), "n_name")))):
        got = store.multi_get(keys.toDF("key").select(F.encode("key", "UTF-8").alias("key")))
        rows = got.collect()  # the rows of region and nation
        out.append((asked, len(rows), sum(r.status == "OK" for r in rows), scanned_rows(got, "value")))
    return spark.createDataFrame(out, "asked string, keys long, found long, rows_scanned long")


@query(f"SELECT count(*) AS entries, true AS disjoint, CAST(1 AS BIGINT) AS levels, CAST(0 AS BIGINT) AS tombstones FROM ({LIVE_PROPS})")
def store_levels(spark, sf_dir):
    """Small levels filled by picked merges, then merged into one: disjoint tables of about the target size, without tombstones."""
    store = loaded(spark, sf_dir, "levels-store", SMALL, maintain=True)
    store.compact()
    ranges = integrity.disjoint(store.manifest())
    out = ranges.agg(F.sum("entry_count").alias("entries"), F.every("disjoint").alias("disjoint"), F.count_distinct("level").alias("levels"))
    return out.withColumn("tombstones", F.lit(store.layers().where("tombstone").count()).cast("long"))


@query(f"SELECT level, ordinal, true AS in_order FROM (SELECT 0 AS level, unnest(range(4)) AS ordinal)")
def level_order(spark, sf_dir):
    """Level 0 by descending id."""
    rows = loaded(spark, sf_dir, "order-store", Options(l0_trigger=9)).manifest().where("level = 0").groupBy("level", "table_id").agg(F.min("ordinal").alias("first"))
    w = Window.partitionBy("level").orderBy("first")
    return rows.select("level", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.coalesce(F.lag("table_id").over(w) > F.col("table_id"), F.lit(True)).alias("in_order"))


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")
def store_iterator(spark, sf_dir):
    """A cursor over a range, row by row in order."""
    store = LayeredStore(spark, shared_path(spark, "cursor-store"))
    store.apply(table(spark, sf_dir, "customer").select(F.encode("c_name", "UTF-8").alias("key"), F.col("c_custkey").alias("seq"), F.lit(False).alias("tombstone"), F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("value")))
    rows = [(k.decode(), int(v)) for k, v in store.iterator(b"Customer#000000100", b"Customer#000000200")]
    if rows != sorted(rows):
        raise ValueError("a cursor out of order")
    return spark.createDataFrame(rows, "c_name string, c_custkey long")


# -- single writes; the tables of nations and regions have the same few rows at every scale


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[bytes, bytes | None]]:
    """A put of each nation, then a remove of those of region 0."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return [(r.n_name.encode(), str(r.n_nationkey).encode()) for r in rows] + [(r.n_name.encode(), None) for r in rows if r.n_regionkey == 0]


def pairs(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(bytes(k).decode(), int(bytes(v))) for k, v in rows], "n_name string, n_nationkey int")


LIVE_NATIONS = "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey <> 0"


@query(LIVE_NATIONS)
def wal_recovery(spark, sf_dir):
    """Synced single writes, flushed by size on the way, and recovered by the next open."""
    store = LayeredStore(spark, shared_path(spark, "wal-store"), Options(memtable_bytes=1500))
    for k, v in nations(spark, sf_dir):
        store.put(k, v, sync=True) if v is not None else store.remove(k, sync=True)
    return pairs(spark, LayeredStore(spark, store.root).iterator())


@query("SELECT n_name, n_nationkey FROM nation WHERE n_regionkey <> 0 AND n_name >= 'NATION_1' AND n_name < 'NATION_3'")
def memory_scan(spark, sf_dir):
    """A range of rows that no table has yet."""
    store = LayeredStore(spark, shared_path(spark, "memory-store"))
    store.write_many(nations(spark, sf_dir))
    return store.scan(b"NATION_1", b"NATION_3").select(F.decode("key", "UTF-8").alias("n_name"), F.decode("value", "UTF-8").cast("int").alias("n_nationkey"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_regionkey = 0) AS dead, sum(length(n_name)) AS names, sum(length(n_name) + length(CAST(n_nationkey AS VARCHAR))) FILTER (n_regionkey <> 0) AS live, sum(length(n_name)) FILTER (n_regionkey = 0) AS gone FROM nation)
SELECT unnest(['gets', 'flushes', 'wal_records_replayed', 'compactions', 'tables_obsoleted', 'memtable_entries', 'memtable_bytes', 'bloom_checks', 'bloom_rejects', 'block_reads']) AS counter,
unnest([CAST(2 AS BIGINT), 1, n + dead, 1, 1, 0, 0, 1, 0, 1]) AS value FROM n""")
def store_counters(spark, sf_dir):
    """The counters after a recovery, a merge and gets of a live and an empty key."""
    store = LayeredStore(spark, shared_path(spark, "counted-store"))
    store.write_many(nations(spark, sf_dir))
    store.sync()
    store = LayeredStore(spark, store.root)
    store.compact()
    name = next(k for k, v in nations(spark, sf_dir) if (k, None) not in nations(spark, sf_dir))
    store.get(name), store.get(b""), store.get(b"~")
    got = store.stats()
    rows = [(c, got[c]) for c in ("gets", "flushes", "wal_records_replayed", "compactions", "tables_obsoleted", "memtable_entries", "memtable_bytes", "bloom_checks", "bloom_rejects", "block_reads")]
    return spark.createDataFrame(rows, "counter string, value long")


@query("SELECT count(*) AS entries, CAST(sum(64 + length(n_name) + CASE WHEN n_regionkey <> 0 THEN length(CAST(n_nationkey AS VARCHAR)) ELSE 0 END) AS BIGINT) AS bytes FROM nation")
def held_bytes(spark, sf_dir):
    """Entries and bytes in memory, removes included."""
    store = LayeredStore(spark, shared_path(spark, "held-store"))
    store.write_many(nations(spark, sf_dir))
    got = store.stats()
    return spark.createDataFrame([(got["memtable_entries"], got["memtable_bytes"])], "entries long, bytes long")


@query(LIVE_PROPS)
def adopted_tables(spark, sf_dir):
    """A store whose manifest is gone: its tables are taken as level 0 by id."""
    store = loaded(spark, sf_dir, "adopted-store")
    store.files.delete("manifest")
    return LayeredStore(spark, store.root).resolved().select(*text())


class Died(BaseException):
    """A store stopped as if its process had died."""


def dying(step: str) -> Callable[[str], None]:
    def stop(at: str) -> None:
        if at == step:
            raise Died

    return stop


@query(f"SELECT s.step, l.user_id, l.props FROM ({LIVE_PROPS}) l, (SELECT unnest(['tables_written', 'before_commit', 'committed']) AS step) s")
def layered_crashes(spark, sf_dir):
    """Stores that die at each step of a batch and of a merge, opened again, the batch delivered again."""
    out = []
    for step in ("tables_written", "before_commit", "committed"):
        *first, last = batches(spark, sf_dir)
        store = LayeredStore(spark, shared_path(spark, "crash-store"))
        for k, batch in enumerate(first):
            store.apply(batch, k)
        for work in (lambda s: s.apply(last, 3), lambda s: s.step(force=True)):
            store.stop = dying(step)
            with contextlib.suppress(Died):
                work(store)
            store = LayeredStore(spark, store.root, Options(grace_seconds=0))
            store.apply(last, 3)
        out.append(store.resolved().select(F.lit(step).alias("step"), *text()))
    return reduce(DataFrame.unionByName, out)


@query(f"SELECT s.step, l.user_id, l.props FROM ({LIVE_PROPS}) l, (SELECT unnest(['data_written', 'hints_written', 'before_commit', 'committed']) AS step) s")
def log_crashes(spark, sf_dir):
    """Log stores that die at each step of compaction, opened again."""
    out = []
    for step in ("data_written", "hints_written", "before_commit", "committed"):
        options = Options(max_file_bytes=1, grace_seconds=0)
        store = LogStore(spark, shared_path(spark, "log-crash"), options)
        for batch in batches(spark, sf_dir):
            store.append(batch)
        store.stop = dying(step)
        with contextlib.suppress(Died):
            store.compact()
        out.append(LogStore(spark, store.root, options).live().select(F.lit(step).alias("step"), *text()))
    return reduce(DataFrame.unionByName, out)


@query(f"SELECT user_id, CAST(21 + length(CAST(user_id AS VARCHAR)) + length(props) AS BIGINT) AS size, props FROM ({LIVE_PROPS})")
def log_index(spark, sf_dir):
    """The index of a compacted log, from hints where there are some, and the records that it points at."""
    store = compacted_log(spark, sf_dir)
    index = store.index()
    return index.join(store.records(index), "key").select(*text(), "size")


@query("SELECT unnest([1, 4]) AS file_id, unnest([true, false]) AS hinted")
def log_files_kept(spark, sf_dir):
    """Files of the log after compaction: one with hints, and the newest."""
    return compacted_log(spark, sf_dir).segments().select(F.col("file_id").cast("int").alias("file_id"), F.col("hints").alias("hinted"))


# -- the documented files


@query(LIVE_PROPS)
def log_file_recovery(spark, sf_dir):
    """The events as log files of a thousand records, each a file of its own, read back and resolved."""
    folder = shared_path(spark, "log-files")
    rows = changelog(spark, sf_dir).withColumn("file", F.floor(F.col("seq") / 1000) + 1)

    def encode(group: list[dict]) -> dict[str, bytes]:
        group.sort(key=lambda r: r["seq"])
        return {scalars.file_name(group[0]["file"], "log"): b"".join(formats.encode_record(formats.Record(r["key"], r["value"] or b"", r["seq"], r["tombstone"])) for r in group)}

    logs.write_files(rows, folder, "file", encode).collect()  # a row per file
    return resolve.latest(logs.as_changes(logs.read_logs(spark, folder)), seq="seq").select(*text())


@query(f"SELECT user_id, props, user_id % 16 <> 5 AS hinted FROM ({LIVE_PROPS})")
def hint_recovery(spark, sf_dir):
    """Compacted log files with hints, a sixteenth of them damaged: pointers from hints or logs, and their records."""
    folder = shared_path(spark, "hint-files")
    live = resolve.latest(changelog(spark, sf_dir)).withColumn("file", (F.decode("key", "UTF-8").cast("long") % 16 + 16 * F.floor(F.decode("key", "UTF-8").cast("long") / 16_000) + 1))

    def encode(group: list[dict]) -> dict[str, bytes]:
        log, hints = b"", []
        for r in group:
            data = formats.encode_record(formats.Record(r["key"], r["value"], r["seq"]))
            hints.append(formats.Hint(r["key"], r["seq"], len(log), len(data)))
            log += data
        hint, id_ = formats.encode_hints(hints, len(log)), group[0]["file"]
        return {scalars.file_name(id_, "log"): log, scalars.file_name(id_, "hint"): hint[:-1] if id_ % 16 == 6 else hint}

    logs.write_files(live, folder, "file", encode).collect()  # a row per file
    records = logs.read_logs(spark, folder).select("file_id", "offset", "value")
    return logs.read_index(spark, folder).join(records, ["file_id", "offset"]).select(*text(), "hinted")


CUSTOMER_FILES = "c_name >= 'Customer#000000050' AND c_name < 'Customer#000001200'"


def customer_tables(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_path(spark, "table-files")
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 500 + 1).alias("file"), F.encode("c_name", "UTF-8").alias("key"), F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("value"))
    encode = lambda group: {scalars.file_name(group[0]["file"], "sst"): formats.encode_table([formats.Entry(r["key"], r["value"]) for r in sorted(group, key=lambda r: r["key"])], 512)}
    logs.write_files(rows, folder, "file", encode).collect()  # a row per file
    return folder


@query(f"SELECT c_name, c_custkey, c_custkey // 500 + 1 AS table_id FROM customer WHERE {CUSTOMER_FILES}")
def table_range(spark, sf_dir):
    """A range of table files, of which only the blocks in it are parsed."""
    rows = logs.read_tables(spark, customer_tables(spark, sf_dir), b"Customer#000000050", b"Customer#000001200")
    return rows.select(F.decode("key", "UTF-8").alias("c_name"), F.decode("value", "UTF-8").cast("long").alias("c_custkey"), "table_id")


@query("SELECT c_custkey // 500 + 1 AS table_id, min(c_name) AS first, max(c_name) AS last, count(*) AS entries FROM customer GROUP BY 1")
def block_index(spark, sf_dir):
    """The sparse index of table files: blocks follow one another without gaps, and the last key is the table's."""
    folder = customer_tables(spark, sf_dir)
    w = Window.partitionBy("table_id").orderBy("block")
    blocks = logs.key_blocks(spark, folder).withColumn("fits", F.col("at") == F.coalesce(F.lag(F.col("at") + F.col("size")).over(w), F.lit(0)))
    last = blocks.groupBy("table_id").agg(F.max("last_key").alias("last"), F.every("fits").alias("fits")).where("fits")
    entries = logs.read_tables(spark, folder).groupBy("table_id").agg(F.min("key").alias("first"), F.count("*").alias("entries"))
    return entries.join(last, "table_id").select("table_id", F.decode("first", "UTF-8").alias("first"), F.decode("last", "UTF-8").alias("last"), "entries")


@query(f"WITH t AS ({TABLES}) SELECT level, table_id, file_size, entry_count, lpad(CAST(min_key AS VARCHAR), 12, '0') AS low, lpad(CAST(max_key AS VARCHAR), 12, '0') AS high FROM t WHERE table_id > 0")
def manifest_codec(spark, sf_dir):
    """Rows of tables through manifests and back, a manifest per batch."""

    def f(rows: list[dict]) -> list[tuple]:
        levels: list[list] = [[], [], []]
        for r in rows:
            levels[r["level"]].append(formats.TableRef(r["table_id"], r["file_size"], r["entry_count"], b"%012d" % r["min_key"], b"%012d" % r["max_key"]))
        back = formats.decode_manifest(formats.encode_manifest(formats.LevelSet(1 << 31, levels)))
        return [(k, t.table_id, t.size, t.entries, t.low.decode(), t.high.decode()) for k, level in enumerate(back.levels) for t in level]

    rows = as_tables(spark, sf_dir).where("table_id > 0")
    return through(rows, f, "level int, table_id long, file_size long, entry_count long, low string, high string")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'NotFound' WHEN 2 THEN 'IOError' WHEN 3 THEN 'Corruption' ELSE 'InvalidArgument' END AS status, CAST(o_orderkey % 5 AS INT) AS byte,
o_orderpriority AS body FROM orders""")
def response_codec(spark, sf_dir):
    """Responses of all statuses through frames and back, with a status's byte and name."""

    def f(rows: list[dict]) -> list[tuple]:
        sent = b"".join(wire.frame(wire.encode_response(Code(r["o_orderkey"] % 5), f"{r['o_orderkey']}|{r['o_orderpriority']}".encode())) for r in rows)
        out = []
        for code, body in map(wire.decode_response, wire.Frames().feed(sent)):
            key, _, rest = body.decode().partition("|")
            out.append((int(key), str(Status(code)), code.value, rest))
        return out

    return through(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), f, "o_orderkey long, status string, byte int, body string")


@query("SELECT p_partkey, p_name || ', \"' || p_brand || chr(10) || '\"' AS name, p_retailprice AS price FROM part")
def csv_report(spark, sf_dir):
    """Values with separators, quotes and line ends through CSV and back."""
    path = shared_path(spark, "report")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('\n"'))
    write_report(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.col("p_retailprice").alias("price")), path, files=4)
    return read_report(spark, path, "p_partkey long, name string, price double")


@query(f"SELECT s.store, n.n_name, n.n_nationkey FROM ({LIVE_NATIONS}) n, (SELECT unnest(['memory', 'locked', 'served']) AS store) s UNION ALL SELECT 'served log', r_name, r_regionkey FROM region WHERE r_regionkey < 4")
def small_stores(spark, sf_dir):
    """The same writes to stores in memory and behind the service, and the regions to a served log store, read back key by key."""
    writes, out = nations(spark, sf_dir), []
    regions = [(r.r_name.encode(), str(r.r_regionkey).encode() if r.r_regionkey < 4 else None) for r in table(spark, sf_dir, "region").collect()]
    for kind in ("memory", "locked", "served", "served log"):
        service = None
        if kind.startswith("served"):
            service = wire.Service(MemoryStore() if kind == "served" else LogStore(spark, shared_path(spark, "served-log")))
            store = wire.Client("127.0.0.1", service.port)
        else:
            store = MemoryStore() if kind == "memory" else LockedStore(MemoryStore())
        asked = regions if kind == "served log" else writes
        for k, v in asked:
            store.remove(k) if v is None else store.put(k, v)
        out += [(kind, k.decode(), int(v)) for k in sorted({k for k, _ in asked}) for status, v in [store.get(k)] if status.is_ok]
        if service:
            store.close()
            service.stop()
    return spark.createDataFrame(out, "store string, n_name string, n_nationkey int")


@query(f"SELECT 2 * s AS batches, user_id, props FROM ({LIVE_PROPS}), (SELECT 4 AS s)")
def restarted_ingest(spark, sf_dir):
    """A stream of four batches into a store, and once more from a new checkpoint, as a second stream would come: all eight
    batches are taken, and delivering the last again changes nothing."""
    folder = shared_path(spark, "stream-files")
    for batch in batches(spark, sf_dir):
        batch.coalesce(1).write.mode("append").parquet(folder)
    store = LayeredStore(spark, shared_path(spark, "restarted-store"))
    for _ in range(2):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        checkpoint = shared_path(spark, "restarted-checkpoint")
        ingest(stream, store, checkpoint, maintain=False).awaitTermination()
    again = store.apply(batch.where("false"), 3, source=source_of(store, checkpoint))
    return store.resolved().select(F.lit(sum(n + 1 for n in store.state["sources"].values()) + again).alias("batches"), *text())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
