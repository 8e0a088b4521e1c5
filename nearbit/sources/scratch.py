"""Folders for files that one query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; gone when the session ends.

    A local one only if that is unset and all runs in one process, as in tests.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='nearbit-')}"
    path = f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"
    known = spark._jvm.org.apache.hadoop.fs.Path(path)
    known.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(known)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The frame, written and read again: cuts lineage, and a lost executor takes nothing with it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a kept frame that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
