"""The package's own source for executors that do not have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parents[1]
        where = tempfile.mkdtemp(prefix="blockwave-src-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        shutil.copytree(home, Path(where, "src", home.name), ignore=shutil.ignore_patterns("__pycache__"))
        _shipped[app] = shutil.make_archive(str(Path(where, home.name)), "zip", Path(where, "src"))
        spark.sparkContext.addPyFile(_shipped[app])
    return spark
