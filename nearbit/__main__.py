"""Joins, comparison and generators from the command line; see ``python -m nearbit -h``.

An output is a folder, or ``null`` (compute, keep nothing), ``null-cost``
(joins: count what is shipped) or ``null-absolute`` (count what is found).
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from nearbit import api
from nearbit.functions import bits as B
from nearbit.operators.compare import compare, described
from nearbit.operators.strategies import Spec
from nearbit.sources import generators, readers, writers

log = logging.getLogger("nearbit")

#: Command -> strategy.
JOINS = {"naive": "grid", "ball-half": "ball_half", "ball-full": "ball_full", "split": "split", "anchor": "anchor", "auto": "auto", "nested-loop": "nested_loop"}


def whole(least: int, most: int | None = None):
    def parse(text: str) -> int:
        n = int(text)
        if n < least or most is not None and n > most:
            raise argparse.ArgumentTypeError(f"{n} is not in {least}..{'' if most is None else most}")
        return n

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearbit", description=__doc__)
    top.add_argument("--split-bytes", type=whole(1), help="largest part of a file that one task reads")
    top.add_argument("--verbose", action="store_true", help="say what is planned and found")
    sub = top.add_subparsers(dest="command", required=True)
    for name in JOINS:
        p = sub.add_parser(name, help=f"all pairs of a sequence file within a distance, by {name}")
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("distance", type=whole(0))
        if name == "naive":
            p.add_argument("granularity", type=whole(1))
        else:
            p.add_argument("reducers", type=whole(1))
            p.add_argument("bits", type=whole(1, B.WORD))
    p = sub.add_parser("compare", help="differences of two text outputs")
    p.add_argument("first")
    p.add_argument("second")
    p.add_argument("output")
    p.add_argument("reducers", type=whole(1))
    p = sub.add_parser("generate-full", help="a sequence file of all strings")
    p.add_argument("bits", type=whole(0))
    p.add_argument("output")
    p = sub.add_parser("generate-part", help="a sequence file of a share of all strings")
    p.add_argument("bits", type=whole(0))
    p.add_argument("share", type=whole(1), help="one string in so many")
    p.add_argument("output")
    p.add_argument("--seed", type=int, default=42)
    return top


def _pairs(df: DataFrame, output: str) -> None:
    if output == "null":
        writers.discard(df)
    elif output == "null-absolute":
        print(writers.count_pairs(df).first()[0])
    else:
        writers.write_text(df, output)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName(f"nearbit {a.command}").getOrCreate()
    if a.split_bytes:
        readers.split_size(spark, a.split_bytes)
    if a.command == "generate-full":
        writers.write_sequence(generators.universe_full(spark, a.bits), a.output)
    elif a.command == "generate-part":
        writers.write_sequence(generators.universe_sample(spark, a.bits, a.share, a.seed), a.output)
    elif a.command == "compare":
        found = compare(readers.text_pairs(spark, a.first), readers.text_pairs(spark, a.second), reducers=a.reducers)
        if a.output in ("null", "null-absolute"):
            _pairs(found, a.output)
        else:
            described(found).write.mode("errorifexists").text(a.output)
    else:
        points = readers.sequence_points(spark, a.input)
        options = {"grid": a.granularity} if a.command == "naive" else {"bits": a.bits, "reducers": a.reducers}
        if a.output == "null-cost":
            if a.command == "auto":
                parser().error("null-cost needs a strategy of its own")
            spec = Spec(d=a.distance, **options)
            print(writers.count_shipped(api.points_of(points, "v", bits=spec.bits).distinct(), JOINS[a.command], spec).first()[0])
        else:
            _pairs(api.hamming_self_join(points, "v", d=a.distance, strategy=JOINS[a.command], **options), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
