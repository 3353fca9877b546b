"""A bounded cache of shards in the executors."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards


class ShardCache:
    """At most `most` shards stay persisted; the one not used for longest goes first. 0 persists nothing.

    As a context manager it lets all go at the end.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 3):
        self.spark, self.root, self.most = spark, root, most
        self.held: OrderedDict[tuple[str, str, str], DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, table: str, split: str, shard: str) -> DataFrame:
        """A table's rows of one shard."""
        key = (table, split, shard)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        rows = shards.read(self.spark, self.root, table, split).where(F.col("source_shard") == shard)
        if self.most > 0:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)[1].unpersist(blocking=True)
            self.held[key] = rows.persist(StorageLevel.MEMORY_AND_DISK)
        return rows

    def sizes(self) -> dict[tuple[str, str, str], int]:
        """Bytes of each held shard, as far as it was read."""
        return {key: int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for key, rows in self.held.items()}

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist(blocking=True)

    def __enter__(self) -> ShardCache:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()
