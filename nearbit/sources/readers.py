"""Bit strings and pairs from Parquet, sequence files and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit.functions import bits as B


def split_size(spark: SparkSession, most: int) -> None:
    """The largest part of a file, in bytes, that one task of this session reads from now on."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("mapreduce.input.fileinputformat.split.maxsize", str(most))


def parquet_points(spark: SparkSession, path: str, value: Column | str) -> DataFrame:
    """``v`` from an expression over a Parquet table; nulls are left out."""
    col = F.expr(value) if isinstance(value, str) else value
    return spark.read.parquet(path).select(col.cast("bigint").alias("v")).where("v is not null")


def sequence_points(spark: SparkSession, path: str) -> DataFrame:
    """``v`` from a sequence file of (null, int) records."""
    kinds = [f"org.apache.hadoop.io.{k}" for k in ("NullWritable", "IntWritable")]
    form = "org.apache.hadoop.mapreduce.lib.input.SequenceFileInputFormat"
    # The newer input format is the one that heeds the split size.
    rows = spark.sparkContext.newAPIHadoopFile(path, form, *kinds).values().map(lambda v: (v,))
    return spark.createDataFrame(rows, "v int").select(B.from_int32(F.col("v")).alias("v"))


def anchor_table(spark: SparkSession, path: str) -> DataFrame:
    """Anchors, in a column ``c``, from a sequence file."""
    return sequence_points(spark, path).select(F.col("v").alias("c")).distinct()


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(l, r)`` from text lines of two binary strings, smaller first."""
    got = F.split(F.trim("value"), r"\s+", 2)
    pair = spark.read.text(path).select(B.parse(got[0]).alias("a"), B.parse(got[1]).alias("b"))
    return pair.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))
