"""The package itself for the workers of a session that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to all executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_has_lexloom", False):
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():  # not when it was itself imported from such an archive
        at = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(at))
    sc._has_lexloom = True
