"""Parquet tables of a scale-factor folder, read through Spark's own readers so that any store works."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Fixed value: rows that one task of a table dealt by key is to hold.
TASK_ROWS = 250_000


def importable(spark: SparkSession) -> None:
    """Python workers of this session can import this package where its folder is on their machine too (local mode);
    on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder; column pruning and filters reach the scan."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if it is read from fewer files than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, key: str, rows: int, most: int | None = None) -> DataFrame:
    """`df` of some `rows` rows (a Parquet table's count comes from its footers) dealt by `key` into parts of some `most`
    (TASK_ROWS) rows, if that makes more parts than there are cores: the parts are dealt in even rounds over the cores, and what
    a task sorts or groups does not grow with the table. A smaller one stays as it is; a key's rows are in one part, so only keys of few rows gain."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = math.ceil(rows / (most or TASK_ROWS) / cores)
    return df.repartition(rounds * cores, key) if rounds > 1 else df


def written_once(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the folder that driver and executors share (spark.checkpoint.dir), which outlives lost
    executors. Where that is unset, a local session gets a temporary folder that goes with the process; on a cluster there
    is no safe guess, so that is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spandrel-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            at = f"file://{folder}"
        sc.setCheckpointDir(at)
    return df.checkpoint()
