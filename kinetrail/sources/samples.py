"""Stored samples with random access: sample number i is found in one file.

`write` stores samples in global order, each file a range of it, and beside them an index with one
row per file: the number of its first sample, how many it holds, and its first key. The number of a
row is its file's start and its row index, so `numbered` gives all numbers without an exchange,
and `take` finds the files of some numbers by binary search and reads no others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "file string, start long, n long"


def write(samples: DataFrame, folder: str, order: list[str], files: int | None = None) -> DataFrame:
    """Store `samples` sorted by `order`, which should tell rows apart; returns the index.

    A large part is split over files where `order` goes on within it.
    """
    ranged = samples.repartitionByRange(files, *order) if files else samples.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/data")
    key = F.struct(*order)
    rows = samples.sparkSession.read.parquet(f"{folder}/data").select(F.col("_metadata.file_name").alias("file"), *order)
    counted = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    start = F.sum("n").over(Window.orderBy("first", "file")) - F.col("n")  # one row per file
    counted.select("file", start.alias("start"), "n", "first").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    return index(samples.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """file, start, n, first of each file of samples."""
    return spark.read.parquet(f"{folder}/index")


def count(spark: SparkSession, folder: str) -> int:
    return index(spark, folder).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """All samples with their number; narrow, since the index has one row per file."""
    rows = spark.read.parquet(f"{folder}/data")
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts = index(spark, folder).select(F.col("file").alias("_file"), "start")
    return placed.join(F.broadcast(starts), "_file").withColumn("number", F.col("start") + F.col("_row")).select("number", *rows.columns)


def locate(spark: SparkSession, folder: str, numbers: list[int]) -> list[tuple[int, str, int]]:
    """(number, file, row) of each number, by binary search in the index."""
    found = index(spark, folder).select("file", "start", "n").orderBy("start").toArrow()
    starts, sizes, files = found["start"].to_numpy(), found["n"].to_numpy(), found["file"].to_pylist()
    if outside := [i for i in numbers if not 0 <= i < int(sizes.sum())]:
        raise IndexError(f"no sample {outside[0]}")
    at = np.searchsorted(starts, np.array(numbers, np.int64), side="right") - 1
    return [(i, files[k], i - int(starts[k])) for i, k in zip(numbers, at.tolist(), strict=True)]


def take(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    """The samples of some numbers (a batch, say), as often as they are given; only their files are read."""
    places = locate(spark, folder, numbers)
    wanted = spark.createDataFrame(places, "number long, _file string, _row long")
    files = sorted({f"{folder}/data/{file}" for _, file, _ in places})
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{folder}/data").limit(0)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(F.broadcast(wanted), ["_file", "_row"]).select("number", *rows.columns)
