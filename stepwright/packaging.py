"""The package on the executors, for clusters on which it is not installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that their Python workers find it wherever they run."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stepwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the archive while the application lives
    shutil.copytree(here, f"{folder}/package/stepwright", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/stepwright", "zip", f"{folder}/package"))
    _shipped.add(application)
