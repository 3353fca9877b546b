"""Exact deduplication by stateful streaming (operator 9), DataFrame operations only.

The rows are written once with their digest and a row number, the content locator, and the
narrow columns of that table (identifier, digest, locator) are read back as a stream. The
stream keeps keyed state on disk (RocksDB state store, no watermark, hence no
expiry): per digest the largest identifier, its locator and the number of rows seen. Micro
batches aggregate on the map side before they reach the state, so a group that holds a
third of all rows costs one row per task. The final state is read as a table, and every hit
(a row whose digest was kept by another row) is found by its locator and compared byte for
byte with the keeper; a bounded bit table of locators keeps all other texts where they are.

Defined results: null text counts as empty; of rows equal in text and identifier exactly
one is kept (that with the larger locator); a null identifier orders below every other; an
empty input gives an empty result. A digest shared by different bytes raises an error
rather than merging texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, maybe_listed, text_or_empty, without_listed, work_path, written

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    #: Preallocated log files of many small stores would take megabytes each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Rows of one group that one comparison task may get; larger groups are salted into more.
GROUP_ROWS = 1000


KEYS = "id long, digest string, locator long"


def stream_state(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the table written at `source` (id, digest, locator and more) through the stream; return its state by digest.

    `files_per_batch` bounds a micro batch; None takes what is there as one.
    """
    checkpoint = work_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(KEYS)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(source).groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    schema = kept.schema["value"].dataType.names
    value = {old: F.col("value")[old] for old in schema}
    keeper, size = (value[n] for n in schema[:2])
    return kept.select(F.col("key.digest").alias("digest"), keeper["id"].alias("keep_id"), keeper["locator"].alias("keep_locator"), size.alias("group_size"))


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the input rows by locator (with their own columns if `carry`, else the text
    alone), and locator, id, keep_id, group_size, kept, digest of each, after all hits' bytes agreed."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    own = F.struct(*[F.col(c) for c in docs.columns]) if carry else F.struct(text.alias("text"))
    source = work_path(spark, "dedup-rows")
    docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("locator"), own.alias("row")).write.parquet(source)
    rows = spark.read.parquet(source)
    keys = rows.select("id", "digest", "locator")
    if keys.isEmpty():
        return rows, keys.select("locator", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    state = written(stream_state(spark, source, files_per_batch), "dedup-groups")
    groups = keys.join(state, "digest").select("locator", "id", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), "digest")
    groups = written(groups, "dedup-result")
    _check_bytes(rows.select("locator", text_or_empty(f"row.{text_col if carry else 'text'}").alias("text")), groups)
    return rows, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Only `id_col` and `text_col` are read, so extra columns cannot clash.
    """
    _, groups = decided(docs, id_col, text_col, files_per_batch)
    return groups.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _check_bytes(texts: DataFrame, groups: DataFrame) -> None:
    """Compare the bytes of every hit with its keeper's; groups above GROUP_ROWS meet in salted parts."""
    parts = F.ceil(F.col("group_size") / GROUP_ROWS).cast("int")
    hits = groups.where("group_size > 1").select("locator", "digest", "kept", parts.alias("parts"))
    found = maybe_listed(texts, "locator", hits.select("locator")).where("_maybe").join(hits, "locator")
    rows = found.select("text", "digest", F.explode(F.when(F.col("kept"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("locator"), F.col("parts")).cast("int")))).alias("part"))
    #: min and max of a group's texts agree only where all its bytes do; both combine on the map side.
    bad = rows.groupBy("digest", "part").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low != high").count()
    if bad:
        raise ValueError(f"{bad} groups share a digest but not their bytes")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that stay: of equal texts (null counts as empty) that with the largest
    doc_id, a null doc_id below every other; of rows equal in both the one with the larger locator.

    Only rows whose locator may be among the dropped ones are shuffled.
    """
    rows, groups = decided(docs, carry=True)
    return without_listed(rows.select("locator", "row"), "locator", groups.where("NOT kept").select("locator")).select("row.*")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
