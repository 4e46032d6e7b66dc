"""Making the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, unless PYTHONPATH already has it for every process."""
    ctx = spark.sparkContext
    if ctx.applicationId in _done:
        return
    _done.add(ctx.applicationId)
    root = os.path.dirname(_PACKAGE)
    if root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] or not os.path.isdir(_PACKAGE):
        return
    # the archive is the driver's own; Spark's file server hands it to the executors
    name = os.path.join(tempfile.mkdtemp(prefix="loomwork-"), "loomwork.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    ctx.addPyFile(name)
