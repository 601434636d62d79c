"""Send this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: a zip of the package, by Spark's own file distribution."""
    context = spark.sparkContext
    if "quarry.zip" not in context._python_includes:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp()
        made = shutil.make_archive(os.path.join(folder, "quarry"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(made)
    return spark
