"""Getting this package to the Python workers, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; executors that join later get it too.

    Call it before making a Python function of this package part of a plan. The archive lies in the
    driver's own session folder, from which Spark serves it.
    """
    sc = spark.sparkContext
    name = f"{PACKAGE.name}.zip"
    if name in sc._python_includes or not PACKAGE.is_dir():
        return
    path = os.path.join(sc._temp_dir or tempfile.mkdtemp(prefix="decistrata-"), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
