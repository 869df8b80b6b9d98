"""python -m barloom COMMAND: jobs over whole tables, all symbols at once. A failed job exits with 1."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import WindowSpec
from .session import build_session

log = logging.getLogger("barloom")


def _resample(spark: SparkSession, args) -> DataFrame:
    from .operators.resample import resample

    return resample(spark.read.parquet(args.input), args.interval)


def _align(spark: SparkSession, args) -> DataFrame:
    from .operators.align import between, lookback, market_state

    def side(path):
        return between(spark.read.parquet(path), lookback(args.start_ms), args.end_ms) if path else None

    return market_state(between(spark.read.parquet(args.input), args.start_ms, args.end_ms), side(args.funding), side(args.open_interest))


def _windows(spark: SparkSession, args) -> DataFrame:
    from .operators.features import build_features
    from .operators.windows import create_windows

    return create_windows(build_features(spark.read.parquet(args.input), args.style), WindowSpec(args.length, args.stride, args.max_gap_ms))


def _convert(spark: SparkSession, args) -> DataFrame:
    from .sources.archives import convert, read_zipped_csv

    return convert(read_zipped_csv(spark, args.input, args.dataset_type), args.dataset_type)


def _validate(spark: SparkSession, args) -> DataFrame:
    from .operators.quality import rule_counts, timestamp_report

    frame = spark.read.parquet(args.input)
    keys = tuple(k for k in ("symbol",) if k in frame.columns)
    from pyspark.sql import functions as F

    times = timestamp_report(frame, args.dataset_type, keys=keys).groupBy("rule").agg(F.sum("bad_count").alias("bad_count"))
    return times.unionByName(rule_counts(frame, args.dataset_type))


def _report(spark: SparkSession, args) -> DataFrame:
    from .operators.quality import quality_report

    return quality_report(spark.read.parquet(args.input))


COMMANDS = {"convert": _convert, "resample": _resample, "align": _align, "windows": _windows, "validate": _validate, "report": _report}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barloom", description=__doc__)
    top.add_argument("command", choices=sorted(COMMANDS))
    top.add_argument("input", help="path or glob of the input table")
    top.add_argument("output", help="folder that is written as Parquet")
    top.add_argument("--interval", default="1h")
    top.add_argument("--dataset-type", default="klines")
    top.add_argument("--funding")
    top.add_argument("--open-interest")
    top.add_argument("--start-ms", type=int)
    top.add_argument("--end-ms", type=int)
    top.add_argument("--style", choices=("raw", "returns"), default="raw")
    top.add_argument("--length", type=int, default=WindowSpec.length)
    top.add_argument("--stride", type=int, default=WindowSpec.stride)
    top.add_argument("--max-gap-ms", type=int, default=WindowSpec.max_gap_ms)
    top.add_argument("--mode", choices=("errorifexists", "overwrite", "append"), default="errorifexists")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = spark or build_session(f"barloom-{args.command}")
    try:
        COMMANDS[args.command](spark, args).write.mode(args.mode).parquet(args.output)
    except Exception:
        log.exception("%s failed", args.command)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
