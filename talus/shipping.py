"""Sending this package to the executors, which need it wherever Python runs in tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Sends the package once a session. The registered queries do so; callers of operators on their own call it first."""
    context = spark.sparkContext
    if not getattr(context, "_talus_shipped", False):
        package = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="talus-package-"), "talus-package.zip")
        with zipfile.ZipFile(to, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(to))
        context._talus_shipped = True
