"""What the jobs share: configuration files and command lines."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("kinetrail.jobs")


def defaults(module: str) -> dict[str, Any]:
    """The configuration file beside a job's module."""
    return json.loads(Path(module).with_suffix(".json").read_text(encoding="utf-8"))


def configured(spark: SparkSession, module: str, path: str | None) -> dict[str, Any]:
    """The defaults, with the values of the JSON file at `path` (any path that Spark reads) over them."""
    config = defaults(module)
    if path is not None:
        given = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if unknown := given.keys() - config.keys():
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        config |= given
    return config


def write(rows: DataFrame, path: str, by: list[str], replace: str = "static", rebalance: bool = True) -> None:
    """`rows` partitioned by `by`; replaces the table, or with replace="dynamic" only the partitions at hand.

    Rebalanced first, so that not every task writes a small file to every partition: rows of one partition
    come together, and adaptive execution splits those that are too many for a task.
    """
    rows = rows.hint("rebalance", *by) if rebalance else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(*by).parquet(path)


def main(description: str, module: str, run: Callable, argv: list[str] | None = None) -> None:
    """The command line of a job: the only place that creates and stops a session."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--source", required=True, help="path of the table to read")
    parser.add_argument("--target", required=True, help="folder to write to")
    parser.add_argument("--config", help=f"JSON file with settings over those of {Path(module).with_suffix('.json').name}")
    arguments = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName(Path(module).stem).getOrCreate()
    try:
        run(spark, arguments.source, arguments.target, configured(spark, module, arguments.config))
    finally:
        spark.stop()
