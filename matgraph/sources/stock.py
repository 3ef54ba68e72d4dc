"""The stock steps. They write files; their entries are opaque, and their values paths."""

from __future__ import annotations

import hashlib
import os
import shutil
import ssl
import stat
import subprocess
import tarfile
import tempfile
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from matgraph.functions.digest import hash_directory_tree
from matgraph.operators.aliases import AliasOf
from matgraph.operators.executor import is_dataframe
from matgraph.plans.nodes import Derivation, FileLike, Realizable, derivation, expression, output
from matgraph.streaming.progress import progress

BLOCK = 1 << 16
#: Variables that may name a certificate bundle, in this order; and the opt-out.
CA_VARIABLES = ("MATGRAPH_CA_BUNDLE", "REQUESTS_CA_BUNDLE", "SSL_CERT_FILE")
INSECURE_VARIABLE = "MATGRAPH_INSECURE_TLS"


def tls_context() -> ssl.SSLContext:
    if os.environ.get(INSECURE_VARIABLE, "").strip().lower() in ("1", "true", "yes"):
        return ssl._create_unverified_context()
    bundle = next((v for k in CA_VARIABLES if (v := os.environ.get(k))), None)
    return ssl.create_default_context(cafile=bundle)


def _digest(path: Path, hasher: Any) -> bytes:
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            hasher.update(block)
    return hasher.digest()


class _Metered:
    """A file for writing that hands on what is written, and how much that is so far."""

    def __init__(self, file: Any, seen: Callable[[bytes], Any], so_far: Callable[[int], Any]):
        self._file, self._seen, self._so_far = file, seen, so_far

    def write(self, block: bytes) -> None:
        self._file.write(block)
        self._seen(block)
        self._so_far(self._file.tell())


def _expect(what: str, found: bytes, wanted: bytes | None) -> None:
    if wanted is not None and found != wanted:
        raise ValueError(f"{what} has digest {found.hex()}, not {wanted.hex()}")


def DownloadFile(filename: str, url: str, hash: bytes | None, hasher_factory: Callable = hashlib.sha256) -> Derivation:
    """A file over HTTP(S), streamed. Addressed by its expected digest, or else by its URL."""

    def fetch(_: list) -> None:
        out, report, hasher = output(), progress(), hasher_factory()
        report.status(f"downloading {filename}")
        context = tls_context() if url.lower().startswith("https") else None
        with urllib.request.urlopen(url, context=context) as response, open(out, "wb") as f:
            if size := int(response.headers.get("content-length") or 0):
                report.total(size)
            shutil.copyfileobj(response, _Metered(f, hasher.update, report.set), BLOCK)
        _expect(f"download {filename}", hasher.digest(), hash)

    return Derivation(filename, hash if hash is not None else hashlib.sha256(url.encode()).digest(), [], fetch)


def GitClone(filename: str, url: str, commit: str, expected_hash: bytes, hasher_factory: Callable = hashlib.sha256) -> Derivation:
    """The tree of a commit, without history; addressed by its digest."""

    def clone(_: list) -> None:
        out = Path(output())
        # Beside the output, so that the last move is a rename.
        work = Path(tempfile.mkdtemp(prefix=f"_{filename}.clone-", dir=out.parent))
        try:
            git = lambda *args: subprocess.run(["git", *args], check=True, capture_output=True, text=True)
            try:
                git("clone", "--quiet", "--no-checkout", url, str(work / "tree"))
                git("-C", str(work / "tree"), "checkout", "--quiet", "--detach", commit)
            except subprocess.CalledProcessError as e:
                raise RuntimeError(f"git clone of {url}: {e.stderr.strip()}") from None
            shutil.rmtree(work / "tree" / ".git")
            hasher = hasher_factory()
            hash_directory_tree(hasher, work / "tree")
            _expect(f"repository {filename}", hasher.digest(), expected_hash)
            os.rename(work / "tree", out)
        finally:
            shutil.rmtree(work, ignore_errors=True)

    return Derivation(filename, expected_hash, [], clone)


def LocalFile(filepath: str | Path) -> Derivation:
    """A copy of a local file, addressed by its content as it is now."""
    path = Path(filepath)
    return Derivation(path.name, _digest(path, hashlib.sha256()), [], lambda _: shutil.copy(path, output()))


def LocalSymlink(name: str, filepath: str | Path) -> Derivation:
    """A link to a local path, addressed by the path."""
    return Derivation(name, hashlib.sha256(str(filepath).encode()).digest(), [], lambda _: os.symlink(filepath, output()))


def _unpack_tar(archive: Any) -> None:
    with tarfile.open(archive, "r:gz") as t:
        t.extractall(output(), filter="data")  # refuses entries that leave the folder


def ExtractTarball(input_der: Derivation) -> Derivation:
    return derivation(input_der.name.removesuffix(".tar.gz"))(_unpack_tar)(input_der)


def _unpack_zip(archive: Any) -> None:
    from matgraph.sources.archives import safe

    out = Path(output())
    out.mkdir()
    with zipfile.ZipFile(archive) as z:
        if bad := [m for m in z.namelist() if not safe(m)]:
            raise ValueError(f"entry {bad[0]!r} leaves the archive")
        z.extractall(out)


def ExtractZip(input_der: Derivation) -> Derivation:
    return derivation(input_der.name.removesuffix(".zip"))(_unpack_zip)(input_der)


def _unpack_member(archive: Any, member: str) -> None:
    with zipfile.ZipFile(archive) as z, z.open(member) as source, open(output(), "wb") as f:
        shutil.copyfileobj(source, f)


def ExtractFromZip(zip_file: Realizable, filename: str) -> Derivation:
    """One member as a file of its own."""
    return derivation(Path(filename).name)(_unpack_member)(zip_file, filename)


def _pointed(value: Any) -> Any:
    """A published dataset under another name: an alias that holds no files. Other frames are published."""
    uri = getattr(value, "matgraph_uri", None)
    return value if uri is None else AliasOf(uri)


def _link(value: Any) -> Any:
    if is_dataframe(value):
        return _pointed(value)
    os.symlink(value, output())


def Symlink(name: str, input: FileLike) -> Derivation:
    """An entry that links to another's value."""
    return derivation(name)(_link)(input)


def _again(value: Any) -> Any:
    """The value's content as this step's own: datasets are pointed at, which keeps them, files copied."""
    if is_dataframe(value):
        return _pointed(value)
    copies = {stat.S_IFDIR: shutil.copytree, stat.S_IFREG: shutil.copy}
    kind = stat.S_IFMT(os.stat(value).st_mode) if os.path.exists(value) else None
    if kind not in copies:
        raise ValueError(f"{value} is neither a file nor a folder")
    copies[kind](value, output())


def Rename(name: str, input: Realizable) -> Derivation:
    """The same content under another name."""
    return derivation(name)(_again)(input)


@expression()
def ChildFile(parent: Any, child: str) -> Any:
    """A path below a realized folder; of a dataset, the part that a sub-folder holds."""
    if is_dataframe(parent):
        root = parent.matgraph_uri
        return parent.sparkSession.read.option("basePath", root).parquet(f"{root}/{child}")
    return Path(parent) / child


@expression()
def Constant(x: Any) -> Any:
    return x


@expression()
def Gather(*nodes: Any) -> list:
    """The values of several steps in order: the fan-in by which one run builds them all."""
    return list(nodes)
