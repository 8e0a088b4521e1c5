"""Sinks: text pairs, sequence files, and the three discard modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.functions import bits as B
from nearbit.operators.strategies import STRATEGIES, Spec


def rendered(pairs: DataFrame) -> DataFrame:
    """Pairs as 32-character binary text."""
    return pairs.select(B.render(F.col("l")).alias("l"), B.render(F.col("r")).alias("r"))


def write_text(pairs: DataFrame, path: str) -> None:
    """Tab-separated binary text; fails if the path exists."""
    rendered(pairs).select(F.concat_ws("\t", "l", "r").alias("value")).write.mode("errorifexists").text(path)


def write_sequence(points: DataFrame, path: str) -> None:
    """Sequence file of (null, int) records."""
    values = points.select(B.to_int32(F.col("v")).alias("v")).rdd.map(lambda r: (None, r.v))
    values.saveAsSequenceFile(path)


def discard(pairs: DataFrame) -> None:
    """Computes everything, keeps nothing (``null``)."""
    pairs.write.format("noop").mode("overwrite").save()


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Computes and verifies, reports only the number (``null-absolute``)."""
    return pairs.agg(F.count("*").alias("n_pairs"))


def count_shipped(points: DataFrame, strategy: str, spec: Spec) -> DataFrame:
    """Rows a strategy sends through its exchange (``null-cost``)."""
    return STRATEGIES[strategy][0](points, spec).agg(F.count("*").alias("n_rows"))


def exchanged(rows: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """``(n_rows, n_bytes)`` that really go through an exchange on ``keys``, by the metrics of the plan that ran.

    The rows are dealt out and thrown away; nothing behind the exchange is computed.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    run = dealt._jdf.queryExecution()
    run.toRdd().count()
    found, waiting = None, [run.executedPlan()]
    while waiting and found is None:  # from the top, so that the first exchange is the one above
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found = node.metrics()
        elif name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            below = node.children()
            waiting += [below.apply(i) for i in range(below.size())]
    if found is None:
        raise RuntimeError("the plan has no exchange")
    return spark.createDataFrame([(found.apply("shuffleRecordsWritten").value(), found.apply("shuffleBytesWritten").value())], "n_rows long, n_bytes long")
