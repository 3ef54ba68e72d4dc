"""One build of an entry at a time, across threads, processes and drivers.

A lock is a file made exclusively beside the entry, kept fresh by a heartbeat. A
stale one is taken over. It carries its owner's token, and only its owner removes
it: an owner that was taken for dead doesn't delete its successor's lock.
"""

from __future__ import annotations

import json
import logging
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

log = logging.getLogger(__name__)


class BuildLock:
    def __init__(self, files: Any, entry: str, *, stale_after: float, heartbeat: float, poll: float):
        self.files, self.entry, self.name = files, entry, f"{entry}.lock"
        self.stale_after, self.heartbeat, self.poll = stale_after, heartbeat, poll
        self.token = uuid.uuid4().hex
        self._over = threading.Event()
        self._beat: threading.Thread | None = None

    def _mine(self) -> bool:
        try:
            return json.loads(self.files.read(self.name) or b"{}").get("token") == self.token
        except ValueError:
            return False

    def acquire(self, done: Callable[[], bool], waiting: Callable[[], None], aborted: Callable[[], bool]) -> bool:
        """True with the lock held; False if the entry appears while waiting, or on
        abort. ``waiting`` is called once, if there is a wait."""
        body = json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "started": time.time(), "token": self.token}).encode()
        told = False
        while not self.files.create(self.name, body):
            if aborted():
                return False
            age = self.files.age(self.name)
            if age is not None and age > self.stale_after:
                log.warning("taking over the lock of %s, stale for %.0f s", self.entry, age)
                self.files.remove(self.name)
                continue
            if not told:
                told = True
                waiting()
            time.sleep(self.poll)
            if done():
                return False
        self._beat = threading.Thread(target=self._beats, name="matgraph-lock", daemon=True)
        self._beat.start()
        return True

    def _beats(self) -> None:
        while not self._over.wait(self.heartbeat):
            if self._mine():
                self.files.touch(self.name)

    def release(self) -> None:
        self._over.set()
        if self._beat is not None and self._mine():
            self.files.remove(self.name)
