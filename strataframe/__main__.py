"""python -m strataframe [--root DIR] [--engine layered|log|memory] get KEY | put KEY VALUE | delete KEY | scan [BEGIN [END]] | compact | stats | serve [PORT]

Exit 0: done; 1: no such key; 2: error."""

from __future__ import annotations

import json
import sys
import threading

from pyspark.sql import SparkSession

from strataframe.model import Code, StoreError, invalid
from strataframe.plans.layered import LayeredStore
from strataframe.plans.logstore import LogStore
from strataframe.plans.memory import MemoryStore


def session() -> SparkSession:
    """The session that spark-submit configured, or a local one."""
    builder = SparkSession.builder.appName("strataframe").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def opened(engine: str, root: str, writer: bool = True):
    """A store of the engine; those on disk may be opened to read only."""
    if engine == "memory":
        return MemoryStore()
    if engine not in ("layered", "log"):
        raise invalid(f"unknown engine {engine}")
    return (LayeredStore if engine == "layered" else LogStore)(session(), root, writer=writer)


def main(args: list[str], store: LayeredStore | None = None) -> int:
    flags = {"--root": "strataframe-data", "--engine": "layered"}
    while args and args[0] in flags and len(args) > 1:
        flags[args[0]], args = args[1], args[2:]
    counts = {"get": (1, 1), "put": (2, 2), "delete": (1, 1), "scan": (0, 2), "compact": (0, 0), "stats": (0, 0), "serve": (0, 1)}
    if not args or args[0] not in counts or not counts[args[0]][0] <= len(args) - 1 <= counts[args[0]][1]:
        print(__doc__, file=sys.stderr)
        return 2
    op, *rest = args
    try:
        store = store or opened(flags["--engine"], flags["--root"], writer=op not in ("get", "scan", "stats"))
        raw = [x.encode() for x in rest]
        if op == "scan":
            if not hasattr(store, "iterator"):
                raise invalid("this engine has no scans")
            for k, v in store.iterator(*raw):
                print(f"{k.decode(errors='replace')}\t{v.decode(errors='replace')}")
            return 0
        if op == "compact":
            if isinstance(store, LayeredStore):
                store.flush()
            print(int(store.compact()))
            return 0
        if op == "stats":
            print(json.dumps(store.stats() if isinstance(store, LayeredStore) else {"files": store.file_count(), "bytes": store.total_disk_size()}))
            return 0
        if op == "serve":
            from strataframe.sources.wire import Service

            service = Service(store, port=int(rest[0]) if rest else 7379)
            print(service.port, flush=True)
            try:
                threading.Event().wait()
            finally:
                service.stop()
                if isinstance(store, LayeredStore):
                    store.flush()
            return 0
        if op == "get":
            status, value = store.get(raw[0])
            if status.is_ok:
                print(value.decode(errors="replace"))
        elif op == "put":
            status = store.put(raw[0], raw[1])
        else:
            status = store.remove(raw[0])
        if isinstance(store, LayeredStore) and op != "get":
            store.sync()
    except StoreError as e:
        status = e.status
    if status.is_ok:
        return 0
    print(status, file=sys.stderr)
    return 1 if status.code is Code.NOT_FOUND else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
