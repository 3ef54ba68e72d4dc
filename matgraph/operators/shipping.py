"""Bring this package to the executors, which may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from typing import Any

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: Any) -> None:
    """Send the package's sources to all Python workers of the session's context, once.
    Spark serves the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_matgraph_shipped", False):
        return
    path = f"{tempfile.mkdtemp(prefix='matgraph-')}/matgraph.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(path)
    context._matgraph_shipped = True
