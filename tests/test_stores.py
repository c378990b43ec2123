"""The store contract, layers, compaction, crashes and recovery, against a dict."""

import hashlib
import random

import pytest

from strataframe.model import Code, Options, StoreError, Tombstones
from strataframe.plans.layered import LayeredStore
from strataframe.plans.logstore import LogStore
from strataframe.plans.memory import LockedStore, MemoryStore
from strataframe.sources.wire import Client, Service

KINDS = ["memory", "locked", "layered", "flushed", "log", "served"]


class Flushed:
    """Every write goes through a table."""

    def __init__(self, store):
        self.store = store

    def put(self, k, v):
        out = self.store.put(k, v)
        self.store.flush()
        return out

    def remove(self, k):
        out = self.store.remove(k)
        self.store.flush()
        return out

    def get(self, k):
        return self.store.get(k)


@pytest.fixture(params=KINDS)
def store(request, spark, tmp_path):
    if request.param == "memory":
        yield MemoryStore()
    elif request.param == "locked":
        yield LockedStore(MemoryStore())
    elif request.param == "layered":
        yield LayeredStore(spark, str(tmp_path))
    elif request.param == "flushed":
        yield Flushed(LayeredStore(spark, str(tmp_path)))
    elif request.param == "log":
        yield LogStore(spark, str(tmp_path))
    else:
        service = Service(MemoryStore())
        client = Client("127.0.0.1", service.port)
        yield client
        client.close()
        service.stop()


def test_put_get_overwrite_remove(store):
    assert store.get(b"alpha")[0].code is Code.NOT_FOUND
    assert store.put(b"alpha", b"one").is_ok
    assert store.get(b"alpha") == (store.get(b"alpha")[0], b"one")
    store.put(b"alpha", b"two")
    assert store.get(b"alpha")[1] == b"two"
    assert store.remove(b"alpha").is_ok and store.remove(b"alpha").is_ok
    assert store.get(b"alpha")[0].code is Code.NOT_FOUND
    store.put(b"alpha", b"three")
    assert store.get(b"alpha")[1] == b"three"


def test_bytes_and_empty_values(store):
    store.put(b"k\0ey", b"a\0b\0c")
    store.put(b"empty", b"")
    assert store.get(b"k\0ey")[1] == b"a\0b\0c"
    assert store.get(b"empty")[0].is_ok and store.get(b"empty")[1] == b""
    assert store.put(b"", b"x").code is Code.INVALID_ARGUMENT
    assert store.remove(b"").code is Code.INVALID_ARGUMENT


def filled(spark, path, **options):
    return LayeredStore(spark, str(path), Options(**options))


def test_layers_scan_and_tombstones(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.write_many([(b"bravo", b"b"), (b"delta", b"d")])
    s.flush()
    s.write_many([(b"alpha", b"a"), (b"charlie", b"c"), (b"delta", None)])
    s.flush()
    s.write_many([(b"echo", b"e"), (b"delta", b"again"), (b"alpha", None)])
    assert list(s.iterator()) == [(b"bravo", b"b"), (b"charlie", b"c"), (b"delta", b"again"), (b"echo", b"e")]
    assert [k for k, _ in s.iterator(b"bravo", b"delta")] == [b"bravo", b"charlie"]
    assert list(s.iterator(b"xray", b"zulu")) == []
    assert s.get(b"alpha")[0].code is Code.NOT_FOUND
    emitted = {bytes(r.key): r.tombstone for r in s.resolved(mode=Tombstones.EMIT).collect()}
    assert emitted[b"alpha"] is True and emitted[b"bravo"] is False


def test_snapshot_is_pinned(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.write_many([(f"k{i}".encode(), b"old") for i in range(20)])
    s.flush()
    version, before = s.state["version"], s.scan()
    s.write_many([(f"k{i}".encode(), b"new" if i % 2 else None) for i in range(30)])
    s.flush()
    assert {bytes(r.value) for r in before.collect()} == {b"old"}
    assert s.scan(version=version).count() == 20
    assert s.scan().count() == 15
    with pytest.raises(StoreError):
        s.scan(version=99)


def test_compaction_keeps_answers_and_drops_tombstones(spark, tmp_path):
    s, oracle, rnd = filled(spark, tmp_path, l0_trigger=2, level_base_bytes=6000, level_multiplier=2, target_table_bytes=3000), {}, random.Random(5)
    for _ in range(6):
        for _ in range(30):
            k = f"key{rnd.randrange(60):03d}".encode()
            if rnd.random() < 0.3:
                s.remove(k)
                oracle.pop(k, None)
            else:
                v = str(rnd.random()).encode()
                s.put(k, v)
                oracle[k] = v
        s.flush()
        s.maintain()
        assert dict(s.iterator()) == oracle
    s.compact()
    assert dict(s.iterator()) == oracle
    assert s.level_count() == 1 and s.layers().where("tombstone").count() == 0
    levels = s.manifest().where("level > 0").orderBy("level", "min_key").collect()
    assert all(a.level != b.level or a.max_key < b.min_key for a, b in zip(levels, levels[1:]))
    for k in list(oracle):
        s.remove(k)
    s.flush()
    s.compact()
    assert s.table_count() == 0 and s.compact() == 0
    s.put(b"after", b"1")
    s.flush()
    assert s.get(b"after")[1] == b"1"


def test_merges_take_as_many_tables_as_a_level_is_over(spark, tmp_path):
    """The number of merges follows the levels, not the tables; and all levels at once become one."""
    s = filled(spark, tmp_path, l0_trigger=1, level_base_bytes=20_000, level_multiplier=2, target_table_bytes=8_000)
    log = lambda k: spark.range(0, 3_000, k).selectExpr("encode(format_string('key%05d', id), 'UTF-8') AS key", f"{k} AS seq", f"{k} > 1 AND id % 2 = 0 AS tombstone", f"encode(IF({k} > 1 AND id % 2 = 0, NULL, concat(md5(string(id)), '-{k}')), 'UTF-8') AS value")
    for k in (1, 3):
        s.apply(log(k))
        assert 2 < s.maintain() <= 2 * s.level_count()
        assert all(s.level_bytes(n) <= 20_000 * 2 ** (n - 1) for n in range(1, s.level_count() + 1) if n < s.options.max_levels - 1)
    assert s.level_count() >= 3 and s.table_count() > 4 * s.level_count()
    want = {f"key{i:05d}".encode(): f"{hashlib.md5(str(i).encode()).hexdigest()}-{1 if i % 3 else 3}".encode() for i in range(3_000) if i % 6}
    assert dict(s.iterator()) == want
    assert s.compact() == 1 and s.level_count() == 1 and s.compact() == 0
    assert dict(s.iterator()) == want and s.layers().count() == len(want)
    levels = s.manifest().orderBy("min_key").collect()
    assert all(a.max_key < b.min_key for a, b in zip(levels, levels[1:]))


@pytest.mark.parametrize("step", ["tables_written", "before_commit", "committed"])
def test_crash_in_compaction(spark, tmp_path, step):
    s = filled(spark, tmp_path, l0_trigger=2)
    s.write_many([(f"k{i:02d}".encode(), b"1") for i in range(12)])
    s.flush()
    s.write_many([(f"k{i:02d}".encode(), None if i % 3 == 0 else b"2") for i in range(12) if i % 3 < 2])
    s.flush()
    want = dict(s.iterator())

    def die(at):
        if at == step:
            raise KeyboardInterrupt

    s.stop = die
    with pytest.raises(KeyboardInterrupt):
        s.step(force=True)
    again = filled(spark, tmp_path, keep_versions=1, grace_seconds=0)
    assert dict(again.iterator()) == want
    named = {t["path"] for level in again.state["levels"] for t in level}
    there = {f"tables/{d}/{n}" for d in again.files.names("tables") for n in again.files.names(f"tables/{d}") if n.endswith(".parquet")}
    assert there == named


def test_log_replay_and_idempotent_batches(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.put(b"a", b"1", sync=True)
    s.remove(b"b", sync=True)
    s.put(b"lost", b"x")
    again = filled(spark, tmp_path)
    assert dict(again.iterator()) == {b"a": b"1"}
    batch = spark.createDataFrame([(bytearray(b"a"), 1, False, bytearray(b"2")), (bytearray(b"a"), 2, True, None), (bytearray(b"c"), 3, False, bytearray(b"3"))], "key binary, seq long, tombstone boolean, value binary")
    assert again.apply(batch, 7) and not again.apply(batch, 7)
    assert dict(again.iterator()) == {b"c": b"3"}
    with pytest.raises(StoreError):
        again.apply(spark.createDataFrame([(bytearray(b""), 1, False, None)], batch.schema))


def test_damaged_manifest_deletes_nothing(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.put(b"a", b"1")
    s.flush()
    tables = s.files.names("tables")
    s.files.write(f"manifest/{s.state['version'] + 1:012d}.json", b"{broken")
    with pytest.raises(StoreError) as e:
        filled(spark, tmp_path)
    assert e.value.status.code is Code.CORRUPTION and s.files.names("tables") == tables


def test_adopts_tables_without_a_manifest(spark, tmp_path):
    s = filled(spark, tmp_path)
    for v in (b"1", b"2"):
        s.put(b"a", v)
        s.flush()
    s.files.delete("manifest")
    again = filled(spark, tmp_path)
    assert again.get(b"a")[1] == b"2" and again.tables_at(0) == sorted(again.tables_at(0), reverse=True)


def test_multi_get_and_stats(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.write_many([(b"a", b"1"), (b"b", None)])
    assert s.memtable_bytes == (1 + 1 + 64) + (1 + 64)
    s.flush()
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b""),), (None,)], "key binary")
    assert sorted((b"?" if r.key is None else bytes(r.key), r.status) for r in s.multi_get(keys).collect()) == [(b"", "InvalidArgument"), (b"?", "InvalidArgument"), (b"a", "OK"), (b"b", "NotFound")]
    got = s.stats()
    assert got["tables"] == 1 and got["flushes"] == 1 and got["bytes"] > 0
    s.reset_stats()
    assert s.stats()["flushes"] == 0


def test_log_store_compaction(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), Options(max_file_bytes=1))
    for i in range(3):
        s.put(b"a", str(i).encode())
    s.remove(b"b")
    dead = {r.file_id: r.dead_bytes for r in s.reclaimable().collect()}
    assert sum(dead.values()) == 2 * (21 + 1 + 1) + (21 + 1)
    assert s.compact() and s.file_count() == 2 and s.get(b"a")[1] == b"2" and s.key_count() == 1
    assert dict((bytes(r.key), r.file_id) for r in s.index().collect()) == {b"a": 1}
    s.put(b"b", b"new")
    assert LogStore(spark, str(tmp_path)).get(b"b")[1] == b"new"


def test_filters_change_cost_not_answers(spark, tmp_path):
    s = filled(spark, tmp_path)
    changes = spark.range(0, 200_000, 2).selectExpr("encode(format_string('key%09d', id), 'UTF-8') as key", "id as seq", "false as tombstone", "encode(string(id), 'UTF-8') as value")
    s.apply(changes)
    s.reset_stats()
    for k in (b"key000000001", b"key000090001", b"key000150001"):
        assert s.get(k)[0].code is Code.NOT_FOUND
    assert s.stats()["rows_scanned"] == 0 and s.stats()["bloom_rejects"] >= 3
    assert s.get(b"key000090000")[1] == b"90000" and 0 < s.stats()["rows_scanned"] < 100_000
    off = filled(spark, tmp_path, bloom_enabled=False)
    assert off.get(b"key000090001")[0].code is Code.NOT_FOUND and off.get(b"key000090000")[1] == b"90000"
    assert off.stats()["rows_scanned"] > 0 and off.stats()["bloom_rejects"] == 0
    assert s.get(b"zzz")[0].code is Code.NOT_FOUND and s.stats()["tables_pruned"] > 0


def rows_of(spark, *rows):
    return spark.createDataFrame([(bytearray(k), i, v is None, None if v is None else bytearray(v)) for i, (k, v) in enumerate(rows)], "key binary, seq long, tombstone boolean, value binary")


def test_streams_restarts_and_redelivery(spark, tmp_path):
    from strataframe.streaming.ingest import ingest, source_of

    s, schema = filled(spark, tmp_path / "store"), "key binary, seq long, tombstone boolean, value binary"
    for name, key in (("one", b"a"), ("two", b"b")):
        rows_of(spark, (key, b"1")).coalesce(1).write.parquet(str(tmp_path / name))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / name)), s, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert dict(s.iterator()) == {b"a": b"1", b"b": b"1"}
    rows_of(spark, (b"a", b"2")).coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
    again = filled(spark, tmp_path / "store")
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "one")), again, str(tmp_path / "cp-one")).awaitTermination()
    assert dict(again.iterator()) == {b"a": b"2", b"b": b"1"}
    source = source_of(again, str(tmp_path / "cp-one"))
    assert not again.apply(rows_of(spark, (b"a", b"old")), 0, source=source) and again.get(b"a")[1] == b"2"
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "two")), again, str(tmp_path / "cp-new")).awaitTermination()
    assert len(again.state["sources"]) == 3


def test_more_batch_ids_than_a_manifest_lists(spark, tmp_path, monkeypatch):
    from strataframe.plans import layered

    monkeypatch.setattr(layered, "LISTED", 3)
    s = filled(spark, tmp_path, l0_trigger=99)
    for i in range(9):
        assert s.apply(rows_of(spark, (b"k%d" % i, b"v")), f"batch-{i}")
    again = filled(spark, tmp_path)
    assert len(again.state["batches"]) <= 3 and not any(again.apply(rows_of(spark, (b"k0", None)), f"batch-{i}") for i in range(9))
    assert len(list(again.iterator())) == 9


def test_readers_delete_nothing(spark, tmp_path):
    s = filled(spark, tmp_path)
    s.apply(rows_of(spark, (b"a", b"1")))
    opened = []

    def look(step):
        if step == "before_commit":
            opened.append(filled(spark, tmp_path))
            opened.append(LayeredStore(spark, str(tmp_path), writer=False))

    s.stop = look
    s.apply(rows_of(spark, (b"b", b"2")))
    assert dict(filled(spark, tmp_path).iterator()) == {b"a": b"1", b"b": b"2"}
    reader = opened[-1]
    assert dict(reader.iterator()) == {b"a": b"1"} and reader.put(b"c", b"3").code is Code.INVALID_ARGUMENT
    reader.refresh()
    assert dict(reader.iterator()) == {b"a": b"1", b"b": b"2"}
    with pytest.raises(StoreError):  # a second writer that opened before the commit
        opened[0].apply(rows_of(spark, (b"c", b"3")))


def test_batch_gets_open_few_tables(spark, tmp_path):
    s = filled(spark, tmp_path, l0_trigger=9)
    for k in range(4):
        s.apply(spark.range(k * 1000, (k + 1) * 1000).selectExpr("encode(format_string('key%09d', id), 'UTF-8') as key", "id as seq", "false as tombstone", "encode(string(id), 'UTF-8') as value"))
    s.reset_stats()
    got = s.multi_get(spark.createDataFrame([(bytearray(b"key000001500"),), (bytearray(b"key000001500x"),)], "key binary")).collect()
    assert sorted((bytes(r.key), r.status) for r in got) == [(b"key000001500", "OK"), (b"key000001500x", "NotFound")]
    assert s.counters["tables_probed"] < s.table_count() and s.counters["tables_pruned"] >= 3
    many = spark.range(900, 4100).selectExpr("encode(format_string('key%09d', id), 'UTF-8') as key")
    assert {(r.status, r["count"]) for r in s.multi_get(many).groupBy("status").count().collect()} == {("OK", 3100), ("NotFound", 100)}
    assert 0 < s.amplification()["space"] < 3  # stored bytes are compressed


def test_log_store_rotation_hints_and_deferred_deletion(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), Options(max_file_bytes=8000))
    for i in range(6):
        s.append(rows_of(spark, *((b"k%d" % j, b"%d" % i) for j in range(i, 12))))
    assert 1 < s.file_count() < 6
    before, plain = s.live(), sorted(map(tuple, s.index().drop("ts", "file_id", "part", "offset").collect()))
    old = {x["folder"] for x in s.state["segments"]}
    assert s.compact()
    assert before.count() == 12 and old <= set(s.files.names("log"))  # a reader of the older version goes on
    assert sorted(map(tuple, s.index().drop("ts", "file_id", "part", "offset").collect())) == plain
    assert "hint/" in s.index()._jdf.queryExecution().executedPlan().toString() and s.files.names("hint")
    off = LogStore(spark, str(tmp_path), Options(ignore_hints=True), writer=False)
    assert sorted(map(tuple, off.index().collect())) == sorted(map(tuple, s.index().collect()))
    assert off.records(off.index()).count() == 12 and off.put(b"x", b"").code is Code.INVALID_ARGUMENT
    assert s.vacuum(keep=1, older_than=0) and not old & set(s.files.names("log")) - {x["folder"] for x in s.state["segments"]}
    s.files.delete("manifest")
    assert dict((bytes(r.key), bytes(r.value)) for r in LogStore(spark, str(tmp_path)).live().collect()) == {b"k%d" % j: b"%d" % min(j, 5) for j in range(12)}
    s.files.write("manifest/000000000099.json", b"{")
    with pytest.raises(StoreError):
        LogStore(spark, str(tmp_path))


def test_engines(spark, tmp_path, capsys):
    from strataframe.__main__ import main, opened

    assert isinstance(opened("memory", ""), MemoryStore)
    assert main(["--engine", "none", "get", "a"]) == 2
    assert main(["--engine", "log", "--root", str(tmp_path / "log"), "put", "a", "1"]) == 0
    assert main(["--engine", "log", "--root", str(tmp_path / "log"), "get", "a"]) == 0 and capsys.readouterr().out.endswith("1\n")
    assert main(["--root", str(tmp_path / "lay"), "put", "a", "2"]) == 0 and main(["--root", str(tmp_path / "lay"), "get", "a"]) == 0
    assert main(["--engine", "log", "--root", str(tmp_path / "log"), "scan"]) == 2
