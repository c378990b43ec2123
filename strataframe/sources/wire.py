"""The framed request and response codec (big-endian), and a small service and client over a store."""

from __future__ import annotations

import socket
import socketserver
import struct
import threading
from dataclasses import dataclass

from strataframe.model import Code, Status, StoreError, invalid

GET, PUT, DELETE = 1, 2, 3
MAX_FRAME = 8 << 20


@dataclass(frozen=True)
class Request:
    op: int
    key: bytes
    value: bytes = b""


def encode_request(r: Request) -> bytes:
    return struct.pack(">BI", r.op, len(r.key)) + r.key + (r.value if r.op == PUT else b"")


def decode_request(payload: bytes) -> Request:
    if len(payload) < 5:
        raise invalid("a request is shorter than its header")
    op, k = struct.unpack_from(">BI", payload)
    if op not in (GET, PUT, DELETE):
        raise invalid(f"unknown operation {op}")
    if 5 + k > len(payload):
        raise invalid("a request's key is longer than its frame")
    key, rest = payload[5 : 5 + k], payload[5 + k :]
    if rest and op != PUT:
        raise invalid("bytes after the key")
    return Request(op, key, rest)


def encode_response(code: Code, body: bytes = b"") -> bytes:
    return bytes([code.value]) + body


def decode_response(payload: bytes) -> tuple[Code, bytes]:
    if not payload or payload[0] > 4:
        raise invalid("no response, or one of unknown status")
    return Code(payload[0]), payload[1:]


def frame(payload: bytes) -> bytes:
    if len(payload) > MAX_FRAME:
        raise invalid("a frame is at most 8 MiB")
    return struct.pack(">I", len(payload)) + payload


class Frames:
    """Frames out of a byte stream, however it is cut."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> list[bytes]:
        self.held += data
        out = []
        while len(self.held) >= 4:
            n = struct.unpack_from(">I", self.held)[0]
            if n > MAX_FRAME:
                raise invalid("a frame is at most 8 MiB")
            if len(self.held) < 4 + n:
                break
            out.append(bytes(self.held[4 : 4 + n]))
            del self.held[: 4 + n]
        return out

    @property
    def torn(self) -> bool:
        return bool(self.held)


def answer(store, payload: bytes) -> bytes:
    try:
        r = decode_request(payload)
        if r.op == GET:
            status, value = store.get(r.key)
        else:
            status, value = (store.put(r.key, r.value) if r.op == PUT else store.remove(r.key)), None
    except StoreError as e:
        status, value = e.status, None
    return encode_response(status.code, value if status.is_ok and value is not None else status.message.encode())


class Service:
    """Answers requests on a port, a thread per connection; the store takes one call at a time."""

    def __init__(self, store, host: str = "127.0.0.1", port: int = 0):
        lock = threading.Lock()

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                frames = Frames()
                while data := self.request.recv(65536):
                    try:
                        payloads = frames.feed(data)
                    except StoreError:
                        return
                    for payload in payloads:
                        with lock:
                            out = answer(store, payload)
                        self.request.sendall(frame(out))

        self.server = socketserver.ThreadingTCPServer((host, port), Handler, bind_and_activate=True)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class Client:
    """The store behind a service."""

    def __init__(self, host: str, port: int):
        self.socket, self.frames = socket.create_connection((host, port)), Frames()

    def _ask(self, r: Request) -> tuple[Status, bytes]:
        self.socket.sendall(frame(encode_request(r)))
        while True:
            data = self.socket.recv(65536)
            if not data:
                raise StoreError(Code.IO_ERROR, "the connection ended")
            if got := self.frames.feed(data):
                code, body = decode_response(got[0])
                return Status(code, "" if code is Code.OK else body.decode(errors="replace")), body

    def get(self, key: bytes) -> tuple[Status, bytes | None]:
        status, body = self._ask(Request(GET, key))
        return status, body if status.is_ok else None

    def put(self, key: bytes, value: bytes) -> Status:
        return self._ask(Request(PUT, key, value))[0]

    def remove(self, key: bytes) -> Status:
        return self._ask(Request(DELETE, key))[0]

    def close(self) -> None:
        self.socket.close()
