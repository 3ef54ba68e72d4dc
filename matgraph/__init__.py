"""Graphs of named, cached dataset steps on Spark."""

from matgraph.functions.digest import hash_directory_tree
from matgraph.operators.executor import LocalExecutor, session
from matgraph.plans.hashing import compute_hash
from matgraph.plans.nodes import (
    DEFAULT_POOL,
    OUTPUT,
    Derivation,
    Expression,
    FileLike,
    Realizable,
    derivation,
    expression,
    output,
)
from matgraph.plans.scheduler import RealizeError, realize
from matgraph.sources.stock import (
    ChildFile,
    Constant,
    DownloadFile,
    ExtractFromZip,
    ExtractTarball,
    ExtractZip,
    Gather,
    GitClone,
    LocalFile,
    LocalSymlink,
    Rename,
    Symlink,
)
from matgraph.streaming.progress import build_env, progress
from matgraph.streaming.reporters import LogReporter, MultiReporter, Reporter, TextReporter
from matgraph.streaming.state import BuildState, Snapshot

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "plans", "sources", "streaming")]
