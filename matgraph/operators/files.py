"""The vault's file operations, on a local folder or any Hadoop file system.

An entry is complete if its marker says so and not because a folder is there: a
dataset has a manifest that is written last, which also holds where a folder's
rename isn't atomic. Opaque entries (files that a body wrote) are published by one
rename.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from pathlib import Path
from typing import Any

MANIFEST = "_matgraph.json"


class LocalFiles:
    """Entries below a local folder."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def path(self, name: str) -> Path:
        return self.root / name

    def uri(self, name: str) -> str:
        return self.path(name).absolute().as_uri()

    def exists(self, name: str) -> bool:
        return os.path.lexists(self.path(name))

    def names(self, below: str = "") -> list[str]:
        return sorted(os.listdir(self.path(below)))

    def mkdir(self, name: str) -> None:
        self.path(name).mkdir(parents=True, exist_ok=True)

    def holds(self, name: str, suffix: str) -> bool:
        """Is there a file with that suffix in the folder, at any depth?"""
        return any(True for _ in self.path(name).rglob(f"*{suffix}"))

    def read(self, name: str) -> bytes | None:
        try:
            return self.path(name).read_bytes()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def write(self, name: str, data: bytes) -> None:
        self.path(name).write_bytes(data)

    def create(self, name: str, data: bytes) -> bool:
        """Make the file if it isn't there; False if it is."""
        try:
            with open(self.path(name), "xb") as f:
                f.write(data)
        except FileExistsError:
            return False
        return True

    def age(self, name: str) -> float | None:
        try:
            return time.time() - os.stat(self.path(name)).st_mtime
        except FileNotFoundError:
            return None

    def touch(self, name: str) -> None:
        try:
            os.utime(self.path(name))
        except FileNotFoundError:
            pass

    def remove(self, name: str) -> None:
        p = self.path(name)
        try:
            if p.is_dir() and not p.is_symlink():
                shutil.rmtree(p, ignore_errors=True)
            else:
                p.unlink(missing_ok=True)
        except OSError:
            pass

    def publish(self, temporary: str, name: str) -> bool:
        """Rename; False if another entry was first, which stays."""
        if self.exists(name):
            return False
        try:
            os.rename(self.path(temporary), self.path(name))
        except OSError:
            if self.exists(name):
                return False
            raise
        return True


class HadoopFiles:
    """The same through Spark's Hadoop client, for HDFS and what else speaks its protocol."""

    def __init__(self, root: str, spark: Any):
        jvm = spark.sparkContext._jvm
        self.root, self._jvm = root.rstrip("/"), jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(root))

    def _at(self, name: str) -> Any:
        return self._path(f"{self.root}/{name}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    uri = path

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, below: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(below) if below else self._path(self.root)))

    def mkdir(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def holds(self, name: str, suffix: str) -> bool:
        found = self._fs.listFiles(self._at(name), True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(suffix):
                return True
        return False

    def read(self, name: str) -> bytes | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        self._put(name, data, True)

    def create(self, name: str, data: bytes) -> bool:
        try:
            self._put(name, data, False)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def age(self, name: str) -> float | None:
        if not self.exists(name):
            return None
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def touch(self, name: str) -> None:
        if self.exists(name):
            self._fs.setTimes(self._at(name), int(time.time() * 1000), -1)

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def publish(self, temporary: str, name: str) -> bool:
        # A rename onto a folder that is there would move into it; the build lock is held.
        if self.exists(name):
            return False
        if not self._fs.rename(self._at(temporary), self._at(name)):
            if self.exists(name):
                return False
            raise OSError(f"can't rename {temporary} to {name} in {self.root}")
        return True


def files_at(root: Any, spark: Any = None) -> LocalFiles | HadoopFiles:
    """By the root's scheme; without one, or with ``file:``, it is local."""
    text = str(root)
    if text.startswith("file:"):
        return LocalFiles("/" + text[5:].lstrip("/"))
    if "://" in text:
        if spark is None:
            raise ValueError(f"{text} needs a Spark session")
        return HadoopFiles(text, spark)
    return LocalFiles(os.path.expanduser(text))


def manifest_of(files: Any, name: str) -> dict | None:
    found = files.read(f"{name}/{MANIFEST}")
    return json.loads(found) if found else None


def complete(files: Any, name: str) -> bool:
    """Is the entry published? A folder of Parquet without its manifest is not, and neither is an
    alias whose target is gone."""
    if not files.exists(name):
        return False
    found = manifest_of(files, name)
    if found is not None:
        return found.get("alias_of") is None or complete(files, found["alias_of"])
    return not files.exists(f"{name}/_SUCCESS")
