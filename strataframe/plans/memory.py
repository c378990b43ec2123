"""Stores in memory: the oracle of the tests, and a wrapper for many threads."""

from __future__ import annotations

import threading

from strataframe.model import Code, Status, StoreError, check_key


class MemoryStore:
    def __init__(self) -> None:
        self.rows: dict[bytes, bytes] = {}

    def put(self, key: bytes, value: bytes) -> Status:
        try:
            self.rows[check_key(key)] = bytes(value)
        except StoreError as e:
            return e.status
        return Status()

    def get(self, key: bytes) -> tuple[Status, bytes | None]:
        try:
            key = check_key(key)
        except StoreError as e:
            return e.status, None
        return (Status(), self.rows[key]) if key in self.rows else (Status(Code.NOT_FOUND), None)

    def remove(self, key: bytes) -> Status:
        try:
            self.rows.pop(check_key(key), None)
        except StoreError as e:
            return e.status
        return Status()

    def scan(self, begin: bytes = b"", end: bytes = b""):
        return [(k, v) for k, v in sorted(self.rows.items()) if k >= begin and (not end or k < end)]

    def size(self) -> int:
        return len(self.rows)


class LockedStore:
    """One call of another store at a time."""

    def __init__(self, store):
        self.store, self.lock = store, threading.Lock()

    def __getattr__(self, name: str):
        call = getattr(self.store, name)

        def locked(*args, **kwargs):
            with self.lock:
                return call(*args, **kwargs)

        return locked if callable(call) else call
