"""Where a session keeps what driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Any


def shared_dir(spark: Any) -> str:
    """The folder of ``spark.checkpoint.dir``. On a single machine, where it may be unset, a
    temporary folder takes its place; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset; on {master} it has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: Any, what: str) -> str:
    return f"{shared_dir(spark)}/matgraph-{what}-{uuid.uuid4().hex[:12]}"


def checkpoints(spark: Any) -> None:
    """Tell the context where checkpoints go, if it doesn't know."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
