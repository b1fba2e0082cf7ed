"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word definition here: \x20 and \x09 to \x0D.
WS = r"\x09-\x0D\x20"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary folder that goes with the process; on a cluster there is no safe guess, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spandrel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(f"file://{folder}")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once as Parquet below the shared folder and read again: it cuts the lineage, survives lost
    executors, and gives later joins true sizes. Folders of one application lie together (`stages_of`)."""
    spark = df.sparkSession
    path = f"{stages_of(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stages_of(spark: SparkSession) -> str:
    """The folder of everything that this application has staged."""
    return f"{shared_dir(spark)}/spandrel-{spark.sparkContext.applicationId}"


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged frame that nothing will read again."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def clear_stages(spark: SparkSession) -> None:
    """Deletes all that this application has staged; for the end of a job, when its results are written."""
    _delete(spark, stages_of(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): the whole row apart, so that no column of the caller's can clash with ours."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each Arrow batch with its texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        yield batch, [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
