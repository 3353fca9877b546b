"""What the corpus operators share: the shared work folder, written tables, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..storage import rows_per_batch, ship, work_path, written

__all__ = ["ASCII_WORD", "documents", "map_arrow", "map_texts", "maybe_listed", "partitions_of", "rows_per_batch", "ship", "slices", "without_listed", "text_or_empty", "work_path", "written"]

#: Bytes of the texts that are Python objects at a time.
SLICE_BYTES = 4_000_000
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that only a few texts (first column) are Python objects at a time:
    at most `rows` rows, and `size` bytes of text unless one text is longer."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, dict], dict]], schema: str, rows: int = 256) -> DataFrame:
    """Map slices of rows in Python. `make()` runs once per task and returns a function from
    (texts, other columns) to output columns. The first column of `df` is the text."""
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in slices(batches, rows):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = apply(batch.column(0).to_pylist(), columns)
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


#: Least and most bits of a native bit table: 2**24 bits are at most 262,144 rows of 16 bytes.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 24


def maybe_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """`rows` with a column `_maybe`: false only where `key` is not in the one column of `listed`.

    A bit table of bounded size, held as (word number, word) rows and broadcast, so that rows
    that cannot be listed need not be shuffled. Beyond MOST_BITS / 16 listed keys more and more
    rows pass. DataFrame operations only.
    """
    name = listed.columns[0]
    bits = min(max(LEAST_BITS, 1 << (16 * listed.count()).bit_length()), MOST_BITS)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = listed.select(slot(name).alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_s & 63))")).alias("_bits"))
    found = rows.join(F.broadcast(words), F.shiftright(slot(key), 6) == F.col("_word"), "left")
    here = F.coalesce(F.getbit("_bits", slot(key).bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return found.select(*[rows[c] for c in rows.columns], here.alias("_maybe"))


def without_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose `key` is not in the one column of `listed`; only rows that may be listed are shuffled."""
    flagged = maybe_listed(rows, key, listed)
    name = listed.columns[0]
    unsure = flagged.where("_maybe").join(listed.withColumnRenamed(name, "_listed"), F.col(key) == F.col("_listed"), "left_anti")
    return flagged.where("NOT _maybe").unionByName(unsure).select(rows.columns)
