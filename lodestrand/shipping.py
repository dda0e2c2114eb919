"""Sends the package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestrand-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it until then
    archive = os.path.join(folder, "lodestrand.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _sent.add(context.applicationId)
