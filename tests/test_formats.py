"""Codecs: round trips, literal bytes, damage; and Spark's readers of the files."""

import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strataframe.functions import scalars
from strataframe.model import Code, StoreError
from strataframe.sources import formats as f
from strataframe.sources import logs, wire

some = st.binary(min_size=1, max_size=40)


@given(some, st.binary(max_size=60), st.integers(0, 2**63), st.booleans())
def test_records(key, value, ts, tombstone):
    if tombstone and value:
        with pytest.raises(StoreError):
            f.encode_record(f.Record(key, value, ts, tombstone))
        body = struct.pack("<QBII", ts, 1, len(key), len(value)) + key + value
        with pytest.raises(StoreError):
            f.decode_record(struct.pack("<I", zlib.crc32(body)) + body)
        value = b""
    r = f.Record(key, value, ts, tombstone)
    data = f.encode_record(r)
    assert f.decode_record(data) == (r, len(data)) and len(data) == 21 + len(key) + len(value)
    for at in (0, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(StoreError):
            f.decode_record(bytes(bad))


def test_valid_prefix_of_a_log():
    data = b"".join(f.encode_record(f.Record(b"k%d" % i, b"v", i)) for i in range(5))
    assert f.valid_bytes(data) == len(data)
    assert len(list(f.scan_records(data[:-1]))) == 4
    bad = bytearray(data)
    bad[30] ^= 1
    assert len(list(f.scan_records(bytes(bad)))) == 1


def test_hints():
    log = b"".join(f.encode_record(f.Record(b"k%d" % i, b"v", i)) for i in range(4))
    hints = [f.Hint(r.key, r.ts, at, n) for at, n, r in f.scan_records(log)]
    data = f.encode_hints(hints, len(log))
    assert f.decode_hints(data, len(log)) == hints
    assert logs.hints_or_log(data, log) == logs.hints_or_log(None, log) == logs.hints_or_log(data[:-1], log) == hints
    for bad in (data[:-1], data[1:], data[:40] + b"x" + data[41:]):
        with pytest.raises(StoreError):
            f.decode_hints(bad, len(log))
    with pytest.raises(StoreError):
        f.decode_hints(data, len(log) + 1)


def test_tables():
    entries = [f.Entry(b"key%03d" % i, b"" if i % 3 == 0 else b"v%d" % i, i % 3 == 0) for i in range(100)]
    data = f.encode_table(entries, 64)
    t = f.Table(data)
    assert list(t) == entries and t.entry_count == 100 and len(t.index) > 10
    assert all(e.key in t.bloom for e in entries)
    for at in (5, len(data) // 2, len(data) - 3, len(data) - 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(StoreError):
            list(f.Table(bytes(bad)))
    for wrong in ([], [entries[1], entries[0]], [entries[0], entries[0]]):
        with pytest.raises(StoreError):
            f.encode_table(wrong)
    with pytest.raises(StoreError):
        f.encode_table(entries, 0)


def test_manifests():
    s = f.LevelSet(9, [[f.TableRef(7, 1000, 42, b"a", b"z"), f.TableRef(5, 1000, 42, b"b", b"y")], [f.TableRef(3, 5000, 42, b"a", b"m")], []])
    data = f.encode_manifest(s)
    assert f.decode_manifest(data) == s
    for n in range(len(data)):
        with pytest.raises(StoreError):
            f.decode_manifest(data[:n])


def test_manifest_rows_that_cannot_be():
    for row in (f.TableRef(0, 1, 1, b"a", b"b"), f.TableRef(3, 1, 1, b"b", b"a")):
        with pytest.raises(StoreError):
            f.decode_manifest(f.encode_manifest(f.LevelSet(9, [[row]])))


def test_known_bytes():
    """Layouts written out by hand, so an error that encoder and decoder share shows."""
    body = bytes.fromhex("0100000000000000" + "00" + "05000000" + "03000000") + b"alphaone"
    assert f.encode_record(f.Record(b"alpha", b"one", 1)) == struct.pack("<I", zlib.crc32(body)) + body
    body = bytes.fromhex("0200000000000000" + "01" + "01000000" + "00000000") + b"k"
    assert f.encode_record(f.Record(b"k", b"", 2, True)) == struct.pack("<I", zlib.crc32(body)) + body
    assert f.encode_entry(f.Entry(b"ab", b"c")) == bytes.fromhex("02000000" + "01000000" + "00") + b"abc"
    data = f.encode_table([f.Entry(b"k", b"v")], 64)
    assert data[-4:] == b"KVST" and struct.unpack_from("<I", data, len(data) - 12)[0] == 1 and struct.unpack_from("<Q", data, len(data) - 52 + 28)[0] >= 0
    assert f.encode_hints([], 77) == b"KVHT" + struct.pack("<QQ", 77, 0) + struct.pack("<I", zlib.crc32(b"KVHT" + struct.pack("<QQ", 77, 0)))
    assert f.encode_manifest(f.LevelSet(2, [])) == f.sealed(b"KVMF" + struct.pack("<III", 1, 2, 0))
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_seeks_read_only_blocks_in_range():
    entries = [f.Entry(b"key%03d" % i, b"v%d" % i) for i in range(0, 200, 2)]
    t, read = f.Table(f.encode_table(entries, 64)), []
    whole = t.block
    t.block = lambda i: read.append(i) or whole(i)
    assert [e.key for e in t.range(b"key050", b"key061")] == [b"key%03d" % i for i in range(50, 62, 2)] and len(read) <= 4 < len(t.index)
    read.clear()
    assert t.get(b"key100").value == b"v100" and len(read) == 1
    assert t.get(b"zzz") is None and t.get(b"key101") is None and list(t.range(b"x")) == []


def test_bloom():
    keys = [b"key%d" % i for i in range(3000)]
    b = scalars.Bloom.decode(scalars.Bloom.build(keys).encode())
    assert all(k in b for k in keys)
    assert sum(b"other%d" % i in b for i in range(3000)) < 90
    assert scalars.probe_count(10) == 7 and scalars.probe_count(0) == 7 and scalars.probe_count(1) == 1 and scalars.probe_count(99) == 30


@given(st.lists(st.binary(max_size=20), max_size=20))
def test_hash(values):
    assert scalars.fnv1a_many(values).tolist() == [scalars.fnv1a(v) for v in values]


def test_known_hash_and_names():
    assert scalars.fnv1a(b"") == 0xCBF29CE484222325 and scalars.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert scalars.file_name(7, "log") == "000007.log" and scalars.file_name(12345678, "sst") == "12345678.sst"
    assert scalars.level_budget(2, 10, 4) == 40 and scalars.keys_for(1500, 100) == 13559172
    with pytest.raises(StoreError):
        scalars.file_name(0, "log")


def test_wire():
    assert wire.frame(wire.encode_request(wire.Request(wire.PUT, b"k", b"v"))) == struct.pack(">IBI", 7, 2, 1) + b"kv"
    sent = wire.frame(b"one") + wire.frame(b"") + wire.frame(b"three")
    frames, got = wire.Frames(), []
    for i in range(len(sent)):
        got += frames.feed(sent[i : i + 1])
    assert got == [b"one", b"", b"three"] == wire.Frames().feed(sent) and not frames.torn
    for bad in (b"", b"\x01\0\0\0", b"\x09\0\0\0\0", b"\x01\0\0\0\x09k", b"\x01\0\0\0\x01kk"):
        with pytest.raises(StoreError):
            wire.decode_request(bad)
    with pytest.raises(StoreError):
        wire.Frames().feed(struct.pack(">I", wire.MAX_FRAME + 1))
    assert wire.decode_response(wire.encode_response(Code.NOT_FOUND, b"x")) == (Code.NOT_FOUND, b"x")


def test_spark_reads_logs_and_tables(spark, tmp_path):
    one = b"".join(f.encode_record(f.Record(b"k%d" % (i % 3), b"v%d" % i, i)) for i in range(6))
    two = f.encode_record(f.Record(b"k1", b"", 9, True))
    (tmp_path / "000001.log").write_bytes(one)
    (tmp_path / "000002.log").write_bytes(two + b"torn")
    rows = logs.read_logs(spark, str(tmp_path))
    from strataframe.operators.resolve import latest

    live = latest(logs.as_changes(rows), seq="seq").collect()
    assert sorted((bytes(r.key), bytes(r.value)) for r in live) == [(b"k0", b"v3"), (b"k2", b"v5")]
    (tmp_path / "000003.log").write_bytes(b"")
    with pytest.raises(Exception, match="sealed"):
        logs.read_logs(spark, str(tmp_path)).collect()
    entries = [f.Entry(b"a%02d" % i, b"v") for i in range(50)]
    (tmp_path / "000009.sst").write_bytes(f.encode_table(entries, 64))
    got = logs.read_tables(spark, str(tmp_path)).orderBy("place").collect()
    assert [bytes(r.key) for r in got] == [e.key for e in entries] and {r.table_id for r in got} == {9}
    assert logs.key_blocks(spark, str(tmp_path)).count() > 5
    assert zlib.crc32(two[4:]) == f.u32(two)


def test_reports(spark, tmp_path):
    from strataframe.sources.reports import read_report, write_report

    rows = [("read, present", 1.5, 3), ('say "hi"\nthere', 0.25, None)]
    write_report(spark.createDataFrame(rows, "workload string, seconds double, runs long"), str(tmp_path / "out"))
    got = read_report(spark, str(tmp_path / "out"), "workload string, seconds double, runs long").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
