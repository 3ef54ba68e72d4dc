"""The progress channel of a run.

Builds, their child processes and the scripts those start send datagrams of
``KEY=VALUE`` lines (ID, DONE, TOTAL, STATUS) to a loopback port of the run. Sending
never waits: what can't be delivered is lost. Numbers are sent at most every
``COALESCE`` seconds; totals and changed texts at once.
"""

from __future__ import annotations

import contextlib
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

ENV_CHANNEL, ENV_BUILD = "MATGRAPH_PROGRESS", "MATGRAPH_BUILD"
COALESCE = 0.1

#: (channel, build) of the build that runs here.
_build: ContextVar[tuple[str, str] | None] = ContextVar("matgraph_build", default=None)


@contextlib.contextmanager
def bound(channel: tuple[str, str] | None):
    token = _build.set(channel)
    try:
        yield
    finally:
        _build.reset(token)


def _here() -> tuple[str, str] | None:
    found = _build.get() or (os.environ.get(ENV_CHANNEL, ""), os.environ.get(ENV_BUILD, ""))
    return found if all(found) else None


class ProgressHandle:
    """What a body reports through; without a channel it does nothing."""

    def __init__(self, channel: str | None = None, build: str | None = None):
        self._build, self._lock, self._sent = build, threading.Lock(), float("-inf")
        self._fields: dict[str, str] = {}
        self._to, self._socket = None, None
        if channel and build:
            host, port = channel.rsplit(":", 1)
            self._to = (host, int(port))

    @property
    def active(self) -> bool:
        return self._to is not None

    def total(self, n: float) -> None:
        self._put("TOTAL", str(n), True)

    def set(self, n: float) -> None:
        self._put("DONE", str(n), False)

    def status(self, text: str) -> None:
        text = text.replace("\n", " ")
        if text != self._fields.get("STATUS", ""):
            self._put("STATUS", text, True)

    def _put(self, key: str, value: str, at_once: bool) -> None:
        with self._lock:
            self._fields[key] = value
            now = time.monotonic()
            if self._to is None or (not at_once and now - self._sent < COALESCE):
                return
            self._sent = now
            lines = [f"ID={self._build}", *(f"{k}={self._fields[k]}" for k in ("DONE", "TOTAL", "STATUS") if self._fields.get(k))]
            if self._socket is None:
                self._socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
                self._socket.setblocking(False)
            # A full queue and a receiver that is gone (ConnectionError) lose the update.
            with contextlib.suppress(BlockingIOError, ConnectionError):
                self._socket.sendto(("\n".join(lines) + "\n").encode(), self._to)


def progress() -> ProgressHandle:
    """The handle of the build that this code runs in."""
    return ProgressHandle(*(_here() or (None, None)))


def build_env() -> dict[str, str]:
    """The environment for a subprocess that reports for this build."""
    found = _here()
    return dict(os.environ) | ({ENV_CHANNEL: found[0], ENV_BUILD: found[1]} if found else {})


def parse_message(data: bytes) -> tuple[str | None, dict[str, str]]:
    """(build, fields) of a datagram. Lines without ``=`` are skipped; only the first
    one splits; the last of equal keys counts."""
    pairs = (line.partition("=") for line in data.decode("utf-8", "replace").split("\n"))
    fields = {key.strip(): value for key, found, value in pairs if found}
    return fields.pop("ID", None), fields


class ProgressServer:
    """Receives the datagrams of one run and hands (build, fields) to ``on_update``, until the
    one that ``close`` sends itself."""

    def __init__(self, on_update: Callable[[str, dict[str, str]], None]):
        self._socket = socket.socket(type=socket.SOCK_DGRAM)
        self._socket.bind(("127.0.0.1", 0))
        self.name = "{}:{}".format(*self._socket.getsockname())
        self._end = uuid.uuid4().bytes
        self._thread = threading.Thread(target=self._hand_on, args=(on_update,), name="matgraph-progress", daemon=True)
        self._thread.start()

    def _hand_on(self, on_update: Callable[[str, dict[str, str]], None]) -> None:
        for build, fields in map(parse_message, iter(lambda: self._socket.recv(1 << 16), self._end)):
            with contextlib.suppress(Exception):  # a listener's fault stops no run
                if build is not None:
                    on_update(build, fields)

    def close(self) -> None:
        with self._socket, contextlib.suppress(OSError):
            self._socket.sendto(self._end, self._socket.getsockname())
            self._thread.join(1.0)
