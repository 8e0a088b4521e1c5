"""Theta joins in cells of a bounded size, and equi-joins whose hot buckets are cut into cells.

Rows are dealt to bands by a hash of the row, so that neither regular values nor
copies gather in one. A cell joins two bands; a pair of bands meets in one cell.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a band of a cell, about.
BAND = 8_000
#: Rows up to which a table of a few numbers is broadcast: some 10 MB.
FEW = 200_000
#: Most partitions that cells are dealt to.
PARTITIONS = 2_000


def by_size(df: DataFrame, most: int = FEW) -> DataFrame:
    """For a join: broadcast if a count allows it, else sort-merge, in which Spark splits hot keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def in_cells(rows: DataFrame, band: Column, bands: Column) -> DataFrame:
    """Each row once for each cell of its band's row and column of a triangle: ``lo``, ``hi`` and whether it stands for ``row`` or ``column``."""
    cell = rows.withColumn("own", band.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (bands - 1).cast("int"))))
    own, other = F.col("own"), F.col("other")
    return cell.select(*rows.columns, F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), (own <= other).alias("row"), (own >= other).alias("column"))


def dealt(rows: DataFrame, ids: list[str], bands: Column | int) -> Column:
    """The band of a row, by a hash of all that tells it apart."""
    return F.pmod(F.xxhash64("v", *ids), bands if isinstance(bands, Column) else F.lit(bands))


def heavy_buckets(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and ``n`` of the buckets with more than ``most`` rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)


def split_buckets(rows: DataFrame, keys: list[str], ids: list[str], most: int) -> DataFrame:
    """The rows in cells: a bucket of ``n`` rows is cut into ``n / most`` bands, small ones are one cell."""
    heavy = heavy_buckets(rows, keys, most).select(*keys, F.ceil(F.col("n") / most).alias("bands"))
    marked = rows.join(by_size(heavy), keys, "left").withColumn("bands", F.coalesce("bands", F.lit(1)))
    return in_cells(marked, dealt(marked, ids, F.col("bands")), F.col("bands")).drop("bands")


def between(points: DataFrame, others: DataFrame, near: Column) -> DataFrame:
    """Points ``v`` and others ``c`` for which ``near`` holds: both are counted and dealt to cells of ``BAND`` by ``BAND`` rows.

    Cells get partitions by their number, since Spark would coalesce them by their few bytes.
    """
    rows, columns = (max(1, ceil(df.count() / BAND)) for df in (points, others))
    parts = min(rows * columns, PARTITIONS)
    a = points.withColumn("p", F.pmod(F.xxhash64(*points.columns), F.lit(rows)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = others.withColumn("q", F.pmod(F.xxhash64("c"), F.lit(columns)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    a, b = (df.repartition(parts, "p", "q") for df in (a, b))
    return a.join(b.hint("merge"), ["p", "q"]).where(near).drop("p", "q")
