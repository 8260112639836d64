"""Sends this package to the executors of a session, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="namtok-")) / "namtok_sources.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path(root.name) / path.relative_to(root))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return spark
