"""Getting this package to the executors' Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless PYTHONPATH has it there already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _SHIPPED or root.parent in paths or not root.is_dir():
        return
    at = tempfile.mkdtemp(prefix="tessera-code-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    shutil.copytree(root, f"{at}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{at}/{root.name}", "zip", f"{at}/src"))
    _SHIPPED.add(sc.applicationId)
