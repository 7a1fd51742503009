"""Session settings that suit these jobs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods of more than 8000 bytes. Stages with many rule
    # expressions get there; below the limit Spark splits them into smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Source files go to the Python parser in batches of bounded size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Recording the Python line of every expression slows down query building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import it by name, also where it isn't installed. Spark copies the archive to every executor.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
        root, name = os.path.split(package)
        context.addPyFile(shutil.make_archive(base, "zip", root, name))
