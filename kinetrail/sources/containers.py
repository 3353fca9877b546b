"""Raw shards as containers: rows of the sound ones, and one status row for each that cannot be read.

`parts.scan` reads shards with Spark's Parquet reader, which fails on a corrupt file or drops it
without a word. Here Spark's binary reader brings whole files, of any file system it reads, and each is
opened by itself in a task: its rows with file and row lineage, or a row that says why there are none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship
from .parts import COLUMNS, sized_shards

ROWS = "part_id string, split string, source_shard string, source_row bigint, code string, ops_count int, status string, error string"
#: Files beyond this are not opened: the binary reader holds one in memory.
MOST_BYTES = 1 << 30
#: Rows of a container that are Arrow batches at a time.
BATCH = 4096


def read(spark: SparkSession, root: str, split: str = "all", max_shards: int | None = None, columns: dict[str, str] = COLUMNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of all containers of the split. `status` is `success`; or, with null part_id and the reason in
    `error`, `corrupt_shard` (no Parquet file, or cut off), `missing_column`, or `too_large`.

    Splits choose the files that are listed; of a file only the three columns are decoded.
    """
    shards = sized_shards(spark, root, split, max_shards)
    named = lambda file: file.rsplit("/", 1)[-1]
    # The binary reader skips empty files, and is kept from those that are too large.
    failed = [(None, name, named(file), None, None, None, "corrupt_shard" if size == 0 else "too_large", f"{size} bytes") for name, file, size in shards if size == 0 or size > most_bytes]
    found = spark.createDataFrame(failed, ROWS)
    columns_of = [columns[c] for c in ("part_id", "code", "ops_count")]
    ship(spark)
    for name in dict.fromkeys(s for s, _, _ in shards):
        files = [f for s, f, size in shards if s == name and 0 < size <= most_bytes]
        if files:
            shard = F.element_at(F.split(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1)
            raw = spark.read.format("binaryFile").load(files).select(F.lit(name).alias("split"), shard.alias("source_shard"), "content")
            found = found.unionByName(raw.mapInArrow(lambda batches: _opened(batches, columns_of), ROWS))
    return found


_SCHEMA = pa.schema([("part_id", pa.string()), ("split", pa.string()), ("source_shard", pa.string()), ("source_row", pa.int64()), ("code", pa.string()), ("ops_count", pa.int32()), ("status", pa.string()), ("error", pa.string())])


def _opened(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            split, shard = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            at = 0
            try:
                container = pq.ParquetFile(pa.BufferReader(batch.column(2)[i].as_buffer()))
                if lacks := [n for n in names if n not in container.schema_arrow.names]:
                    yield _failed(split, shard, "missing_column", ", ".join(lacks))
                    continue
                # A container counts whole or not at all, so all of it is decoded before its rows go on.
                decoded = [_rows(b, names, split, shard, at := at + b.num_rows) for b in container.iter_batches(BATCH, columns=names)]
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, UnicodeDecodeError) as error:
                yield _failed(split, shard, "corrupt_shard", str(error).splitlines()[0][:500])
                continue
            yield from decoded


def _failed(split: str, shard: str, status: str, error: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"split": split, "source_shard": shard, "status": status, "error": error}], schema=_SCHEMA)


def _rows(batch: pa.RecordBatch, names: list[str], split: str, shard: str, end: int) -> pa.RecordBatch:
    n = batch.num_rows
    text = lambda name: pc.cast(batch.column(name), pa.string())
    columns = [text(names[0]), pa.repeat(split, n), pa.repeat(shard, n), pa.array(range(end - n, end), pa.int64()), text(names[1]), pc.cast(batch.column(names[2]), pa.int32()), pa.repeat("success", n), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
