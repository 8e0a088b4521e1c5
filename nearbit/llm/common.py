"""What several operators share: intermediate tables, folds, word arrays, batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at a time.
SLICE = 256


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; a local one only if that is unset and all runs in one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='nearbit-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a frame to the shared folder and reads it again: cuts lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, and lets Spark drop the shuffles of finished jobs."""
    spark = SparkSession.active()
    for df in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # shuffles go with the plans that made them, once these are found to be unused
        gc.collect()
        spark._jvm.System.gc()


#: Rows up to which a table of ids, hashes or short strings may be broadcast: some 30 MB.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """For a join: broadcast if a count allows it, else sort-merge, in which Spark splits hot keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


#: Words of 64 bits in a bitmap, a power of two: 2^22 bits, 512 KB.
BITMAP = 1 << 16


def bitmap(hashes: DataFrame, size: int = BITMAP) -> Column:
    """The bits of the 64-bit hashes ``h`` as an array literal of ``size`` longs, however many they are."""
    cells = hashes.groupBy(F.pmod(F.shiftright("h", 6), F.lit(size)).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("h", F.lit(64)).cast("int"))).alias("x"))
    out = ["0"] * size
    for row in cells.collect():  # at most ``size`` rows
        out[row["at"]] = str(row["x"])
    return F.split(F.lit(",".join(out)), ",").cast("array<bigint>")


def has_bit(h: Column, bits: Column, size: int = BITMAP) -> Column:
    """Whether the bitmap has the hash."""
    at = F.pmod(F.shiftright(h, 6), F.lit(size)).cast("int")
    return F.getbit(F.get(bits, at), F.pmod(h, F.lit(64)).cast("int")) == 1


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; fold 2 is held out. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)).cast("int"), F.lit(2))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The frame with all columns but ``used`` under names that no operator makes, and the columns that give their names back."""
    names = [c if c in used else f"own_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed once, whatever reads them.

    Catalyst merges neighbouring projections when a column is read once, even
    if it is read inside a lambda, which then computes it for every element; it
    does not merge through a generator.
    """
    made = F.struct(*[c.alias(k) for k, c in cols.items()])
    return df.select(*df.columns, F.inline(F.array(made)))


def next_to(array: Column, step: int) -> Column:
    """The array without its first ``step`` elements."""
    return F.slice(array, step + 1, F.greatest(F.size(array) - step, F.lit(0)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
