"""Scalar functions on bytes: checksums, hashes, bloom filters, file ids, sizes and key generators."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.model import MAX_ID, corruption, invalid

#: Fixed values of the 64-bit FNV-1a hash and of the filter's second hash where the first has none.
FNV_OFFSET, FNV_PRIME, NO_DELTA = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B9
U32 = 0xFFFFFFFF


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(values: Iterable[bytes]) -> np.ndarray:
    """The hashes of many byte strings, a byte place at a time."""
    values = [bytes(v) for v in values]
    size = np.array([len(v) for v in values], np.int64)
    flat, start = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64), np.cumsum(size) - size
    h, live = np.full(len(values), FNV_OFFSET, np.uint64), np.arange(len(values))
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            h[live] = (h[live] ^ flat[start[live] + k]) * np.uint64(FNV_PRIME)
    return h


def fnv1a_column(key: Column) -> Column:
    """As a signed 64-bit number; null for null."""

    def hashed(keys: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=keys.index, dtype="Int64")
        some = keys.dropna()
        out[some.index] = fnv1a_many(some).view(np.int64)
        return out

    return F.pandas_udf(hashed, "long")(key)


def probe_count(bits_per_key: int) -> int:
    return max(1, min(30, round((bits_per_key or 10) * math.log(2))))


def probes(key: bytes, count: int, num_bits: int) -> list[int]:
    """Double hashing over 32-bit halves, with wrap-around."""
    h = fnv1a(key)
    at, delta = h & U32, h >> 32 or NO_DELTA
    return [(at + i * delta & U32) % num_bits for i in range(count)]


def probes_column(h: Column, count: int, num_bits: int) -> Column:
    """The places that probes() gives, in their order, of keys with the hash h (a column of fnv1a_column); null for null."""
    at, high = h.bitwiseAND(F.lit(U32)), F.shiftrightunsigned(h, 32)
    delta = F.when(high == 0, F.lit(NO_DELTA)).otherwise(high)
    return F.when(h.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (at + (i * delta).bitwiseAND(F.lit(U32))).bitwiseAND(F.lit(U32)) % num_bits))


class Bloom:
    """A set sketch: never a false no. Blocks are `num_bits 4, num_probes 1, bits, crc 4`, little-endian."""

    def __init__(self, num_bits: int, count: int, bits: bytearray):
        self.num_bits, self.count, self.bits = num_bits, count, bits

    @classmethod
    def build(cls, keys: Iterable[bytes], bits_per_key: int = 10) -> Bloom:
        keys = list(keys)
        size = -(-min(max(64, len(keys) * (bits_per_key or 10)), 0xFFFFFFF8) // 8)
        out = cls(8 * size, probe_count(bits_per_key), bytearray(size))
        for key in keys:
            for at in probes(key, out.count, out.num_bits):
                out.bits[at >> 3] |= 1 << (at & 7)
        return out

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in probes(key, self.count, self.num_bits))

    def encode(self) -> bytes:
        body = struct.pack("<IB", self.num_bits, self.count) + bytes(self.bits)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def decode(cls, block: bytes) -> Bloom:
        if len(block) < 9 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise corruption("damaged filter block")
        num_bits, count = struct.unpack_from("<IB", block)
        if not num_bits or num_bits != 8 * (len(block) - 9) or not 1 <= count <= 30:
            raise corruption("a filter block of another shape")
        return cls(num_bits, count, bytearray(block[5:-4]))


def file_name(file_id: int, kind: str) -> str:
    if not 1 <= file_id <= MAX_ID:
        raise invalid("file ids are from 1 to 2**32 - 1")
    return f"{file_id:06d}.{kind}"


def file_name_column(file_id: Column, kind: str) -> Column:
    digits = file_id.cast("string")
    return F.concat(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), F.lit(f".{kind}"))


def level_budget(level: int, base: int = 10 << 20, multiplier: int = 10) -> int:
    return base * multiplier ** (level - 1) if level >= 1 else 0


def present_key(number: Column) -> Column:
    """16-byte keys of even numbers, as loads write them."""
    return F.format_string("key_%012d", number * 2)


def absent_key(number: Column) -> Column:
    return F.format_string("key_%012d", number * 2 + 1)


def keys_for(megabytes: int, value_bytes: int, key_bytes: int = 16) -> int:
    return megabytes * (1 << 20) // (key_bytes + value_bytes)


def keys_for_column(megabytes: Column, value_bytes: int, key_bytes: int = 16) -> Column:
    return F.floor(megabytes.cast("long") * (1 << 20) / (key_bytes + value_bytes))
