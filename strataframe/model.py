"""Schemas, statuses and options of versioned key-value data.

A change log holds one row per put or remove. `seq` is a total order of writes; `ts` is informational and never
decides which write is newest. A remove is a row with tombstone = true and a null value; an empty value is not a
removed one, and a key is never empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

CHANGELOG = T.StructType().add("key", "binary", False).add("seq", "long", False).add("ts", "long", False).add("tombstone", "boolean", False).add("value", "binary")
LAYER = T.StructType().add("key", "binary", False).add("tombstone", "boolean", False).add("value", "binary").add("level", "integer", False).add("table_id", "long", False)
MANIFEST = T.StructType().add("version", "long", False).add("level", "integer", False).add("ordinal", "integer", False).add("table_id", "long", False).add("file_size", "long", False).add("entry_count", "long", False).add("min_key", "binary").add("max_key", "binary")
POINTER = T.StructType().add("key", "binary", False).add("file_id", "long", False).add("offset", "long", False).add("size", "long", False).add("ts", "long", False)

#: A record's header, key and value together stay below this.
MAX_RECORD = 2**32 - 1
MAX_ID = 2**32 - 1


class Code(Enum):
    """The five outcomes; the values are the wire's."""

    OK = 0
    NOT_FOUND = 1
    IO_ERROR = 2
    CORRUPTION = 3
    INVALID_ARGUMENT = 4


@dataclass(frozen=True)
class Status:
    code: Code = Code.OK
    message: str = ""

    @property
    def is_ok(self) -> bool:
        return self.code is Code.OK

    def __str__(self) -> str:
        name = {Code.OK: "OK", Code.NOT_FOUND: "NotFound", Code.IO_ERROR: "IOError", Code.CORRUPTION: "Corruption", Code.INVALID_ARGUMENT: "InvalidArgument"}[self.code]
        return f"{name}: {self.message}" if self.message else name


class StoreError(Exception):
    """A lifecycle failure, with its status."""

    def __init__(self, code: Code, message: str):
        super().__init__(message)
        self.status = Status(code, message)


#: The refusal of empty and null keys, also as the error of a plan that meets one.
NO_KEY = "a key is not empty"


def corruption(message: str) -> StoreError:
    return StoreError(Code.CORRUPTION, message)


def invalid(message: str) -> StoreError:
    return StoreError(Code.INVALID_ARGUMENT, message)


def check_key(key: bytes) -> bytes:
    """Keys are non-empty byte strings, also for remove()."""
    if not isinstance(key, (bytes, bytearray)):
        raise invalid("a key is a byte string")
    if not key:
        raise invalid(NO_KEY)
    return bytes(key)


class Tombstones(Enum):
    """Readers skip removed keys; compaction keeps them while older layers may hold the key."""

    SKIP = "skip"
    EMIT = "emit"


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 4 << 20
    max_file_bytes: int = 64 << 20
    bits_per_key: int = 10
    bloom_enabled: bool = True
    l0_trigger: int = 4
    level_base_bytes: int = 10 << 20
    level_multiplier: int = 10
    target_table_bytes: int = 2 << 20
    max_levels: int = 7
    keep_versions: int = 3
    ignore_hints: bool = False
    #: Files that no version names are swept once they are this old: until then a writer may be about to commit them.
    grace_seconds: int = 86_400

    def __post_init__(self) -> None:
        for name in ("memtable_bytes", "max_file_bytes", "l0_trigger", "level_base_bytes", "level_multiplier", "target_table_bytes", "max_levels", "keep_versions"):
            if getattr(self, name) <= 0:
                raise invalid(f"{name} is positive")
        if self.grace_seconds < 0:
            raise invalid("grace_seconds isn't negative")

    @property
    def probe_bits(self) -> int:
        """0 bits per key stand for the default."""
        return self.bits_per_key or 10
