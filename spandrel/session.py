"""Session factory for local use; on a cluster the caller passes its own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from spandrel.sources.tables import importable


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local[N] session with UTC time, adaptive execution, one shuffle partition a core, and a checkpoint folder that
    goes with the process."""
    n = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if "spark.checkpoint.dir" not in settings:
        folder = tempfile.mkdtemp(prefix="spandrel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        settings["spark.checkpoint.dir"] = f"file://{folder}"
    builder = SparkSession.builder.master(f"local[{n}]").appName("spandrel")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    importable(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
