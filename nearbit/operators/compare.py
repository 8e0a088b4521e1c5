"""Multiset comparison of two pair outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.functions import bits as B


def compare(first: DataFrame, second: DataFrame, *, reducers: int | None = None) -> DataFrame:
    """Differences of two pair sets ``(l, r)``, orientation aside: ``(kind, l, r, n)``.

    Kinds: missing_in_second, missing_in_first, duplicate_in_first,
    duplicate_in_second; ``n`` counts the pair where it occurs. Empty result:
    the outputs are equal and free of duplicates. ``reducers`` fixes the number
    of partitions that the pairs are dealt to.
    """
    def tagged(df: DataFrame, src: int) -> DataFrame:
        return df.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), F.lit(src).alias("src"))

    both = tagged(first, 1).unionByName(tagged(second, 2))
    if reducers:  # counted before they are dealt, as Spark would do by itself
        part = both.groupBy("l", "r", "src").agg(F.count("*").alias("k"))
        both = part.repartition(reducers, "l", "r")
    else:
        both = both.withColumn("k", F.lit(1))
    of = lambda src: F.coalesce(F.sum(F.when(F.col("src") == src, F.col("k"))), F.lit(0)).cast("bigint")
    counts = both.groupBy("l", "r").agg(of(1).alias("a"), of(2).alias("b"))
    a, b = F.col("a"), F.col("b")

    def found(kind: str, when, n):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), n.alias("n")))

    said = F.array(
        found("missing_in_second", (a > 0) & (b == 0), a),
        found("missing_in_first", (a == 0) & (b > 0), b),
        found("duplicate_in_first", a > 1, a),
        found("duplicate_in_second", b > 1, b),
    )
    return counts.withColumn("x", F.explode(F.filter(said, lambda s: s.isNotNull()))).select("x.kind", "l", "r", "x.n")


def described(found: DataFrame) -> DataFrame:
    """The differences as text lines: kind and count, a tab, both strings in binary."""
    return found.select(F.concat(F.col("kind"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\t"), B.render(F.col("l")), F.lit("/"), B.render(F.col("r"))).alias("value"))
