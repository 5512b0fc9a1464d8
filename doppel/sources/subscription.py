"""Pending transactions by subscription, as a streaming data source: `rpc_pending`.

Options: `url` (ws:// or wss://), `topic` (newPendingTransactions), `key`, `buffer` messages that wait at most, `per_batch`
messages of one micro-batch. One thread reads the socket into a bounded queue: where the query falls behind, the queue fills
and the socket isn't read, so the node holds back. A lost connection is opened and subscribed again, after waits of 1, 2, 4
... 30 seconds; how often is in the offset. Messages can't be asked for again: those of batches that aren't committed are
kept here, and a restarted driver goes on with new ones.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import queue
import socket
import ssl
import struct
import threading
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

BUFFER, PER_BATCH, HANDSHAKE_SECONDS = 65_536, 10_000, 20
#: Fixed value: what a server appends to the key of a handshake.
MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, CLOSE, PING, PONG = 1, 8, 9, 10


class Socket:
    """A client's end of a web socket: text messages, whole."""

    def __init__(self, url: str, key: str | None = None) -> None:
        at = urlsplit(url)
        secure = at.scheme == "wss"
        plain = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), HANDSHAKE_SECONDS)
        self.sock = ssl.create_default_context().wrap_socket(plain, server_hostname=at.hostname) if secure else plain
        self.rest = b""
        nonce = base64.b64encode(os.urandom(16)).decode()
        lines = [f"GET {at.path or '/'}{'?' + at.query if at.query else ''} HTTP/1.1", f"Host: {at.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {nonce}", "Sec-WebSocket-Version: 13"]
        self.sock.sendall("\r\n".join([*lines, *([f"Drpc-Key: {key}"] if key else []), "", ""]).encode())
        while b"\r\n\r\n" not in self.rest:
            self._more()
        head, _, self.rest = self.rest.partition(b"\r\n\r\n")
        want = base64.b64encode(hashlib.sha1((nonce + MAGIC).encode()).digest())
        if b" 101 " not in head.split(b"\r\n")[0] or want not in head:
            raise ConnectionError(head.split(b"\r\n")[0].decode("ascii", "replace"))
        self.sock.settimeout(None)

    def _more(self) -> None:
        got = self.sock.recv(65_536)
        if not got:
            raise ConnectionError("closed")
        self.rest += got

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n:
            self._more()
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def send(self, payload: bytes, kind: int = TEXT) -> None:
        size = len(payload)
        head = bytes([0x80 | kind, 0x80 | (size if size < 126 else 126 if size < 65_536 else 127)])
        head += b"" if size < 126 else struct.pack(">H" if size < 65_536 else ">Q", size)
        mask = os.urandom(4)
        self.sock.sendall(head + mask + bytes(c ^ mask[i % 4] for i, c in enumerate(payload)))

    def receive(self) -> str:
        """The next text message; pings are answered on the way."""
        whole = b""
        while True:
            first, second = self._take(2)
            size = second & 127
            if size >= 126:
                size = struct.unpack(">H" if size == 126 else ">Q", self._take(2 if size == 126 else 8))[0]
            mask = self._take(4) if second & 128 else None
            part, kind = self._take(size), first & 15
            if mask:
                part = bytes(c ^ mask[i % 4] for i, c in enumerate(part))
            if kind == CLOSE:
                raise ConnectionError("closed")
            if kind == PING:
                self.send(part, PONG)
            elif kind != PONG:
                whole += part
                if first & 128:
                    return whole.decode("utf-8", "replace")

    def close(self) -> None:
        try:
            self.sock.close()
        except OSError:
            pass


def subscribe(url: str, topic: str, key: str | None = None) -> tuple[Socket, str]:
    """An open socket and the id of its subscription."""
    conn = Socket(url, key)
    conn.send(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "eth_subscribe", "params": [topic]}).encode())
    answer = conn.receive()
    found = json.loads(answer).get("result")
    if not isinstance(found, str) or not found:
        conn.close()
        raise ConnectionError(f"no subscription id in {answer}")
    return conn, found


def payload(message: str) -> str | None:
    """What a subscription's message carries, as JSON; None for any other message."""
    try:
        read = json.loads(message)
        return json.dumps(read["params"]["result"]) if read.get("method") == "eth_subscription" else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class Feed:
    """A subscription kept open by a thread of its own."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.waiting: queue.Queue = queue.Queue(int(options.get("buffer", BUFFER)))
        self.reconnects, self.errors, self.stopped, self.conn = 0, [], threading.Event(), None
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        tries = 0
        while not self.stopped.is_set():
            try:
                self.conn, _ = subscribe(self.options["url"], self.options.get("topic", "newPendingTransactions"), self.options.get("key"))
                tries = 0
                while not self.stopped.is_set():
                    message = payload(self.conn.receive())
                    if message is not None:
                        self.waiting.put((int(time.time() * 1_000_000), message))  # waits while the queue is full
            except (OSError, ValueError) as e:
                if self.stopped.is_set():
                    return
                self.errors = [*self.errors[-7:], str(e)]
                self.reconnects += 1
                self.stopped.wait(min(30, 2**tries))
                tries += 1

    def take(self, most: int) -> list[tuple]:
        out = []
        while len(out) < most:
            try:
                out.append(self.waiting.get_nowait())
            except queue.Empty:
                break
        return out

    def close(self) -> None:
        self.stopped.set()
        if self.conn:
            self.conn.close()


class PendingStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options, self.feed, self.kept = options, None, {}

    def initialOffset(self) -> dict:
        return {"n": 0, "reconnects": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.feed is None:
            self.feed = Feed(self.options)
        first, got = int(start["n"]), self.feed.take(int(self.options.get("per_batch", PER_BATCH)))
        rows = [(first + k, at, message) for k, (at, message) in enumerate(got)]
        self.kept |= {r[0]: r for r in rows}
        return iter(rows), {"n": first + len(rows), "reconnects": self.feed.reconnects if rows else int(start.get("reconnects", 0))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[k] for k in range(int(start["n"]), int(end["n"])) if k in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {k: r for k, r in self.kept.items() if k >= int(end["n"])}


class PendingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rpc_pending"

    def schema(self) -> str:
        return "event_id long, observed_us long, payload string"

    def simpleStreamReader(self, schema) -> PendingStream:
        return PendingStream(self.options)
