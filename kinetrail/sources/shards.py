"""Trajectory shards as partitioned tables, and documents exported from them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMMANDS, EDGE_FEATURES, FACE_FEATURES, PARAMS, SCHEMA_VERSION, TABLES, VOCABULARY_VERSION
from .parts import normal_split

PARTITIONS = ["split", "source_shard"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pending(parts: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Parts of shards not written yet."""
    spark = parts.sparkSession
    if overwrite or not exists(spark, f"{root}/shard_metadata"):
        return parts
    done = spark.read.parquet(f"{root}/shard_metadata").where("succeeded > 0").select(*PARTITIONS).distinct()
    return parts.join(done, PARTITIONS, "left_anti")


def write(tables: dict[str, DataFrame], attempted: DataFrame, root: str, grid: int = 0, samples: int = 0) -> DataFrame:
    """Write child tables (each with split and source_shard) and the metadata of their shards.

    Only shards at hand are replaced (dynamic partition overwrite); a shard without any
    success gets metadata but no data. `attempted`: split, source_shard, status of each part.
    `grid` and `samples` are the sizes of the grids, for the metadata's shapes. Returns the metadata rows.
    """
    spark = attempted.sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{root}/{name}")
    stamp = attempted.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).cast("int").alias("attempted"), F.count_if(F.col("status") == "success").cast("int").alias("succeeded"))
    stamp = stamp.join(shard_bytes(spark, [f"{root}/{name}" for name in tables]), PARTITIONS, "left")
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    shapes = {"faces": [len(FACE_FEATURES)], "uv": [7, grid, grid], "edges": [len(EDGE_FEATURES)], "u": [6, samples], "params": [PARAMS]}
    meta = stamp.select(
        "source_shard", "split", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(VOCABULARY_VERSION).alias("vocabulary_version"), "attempted", "succeeded", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.current_timestamp().alias("created_at"),
        texts(FACE_FEATURES).alias("face_features"), texts(EDGE_FEATURES).alias("edge_features"), texts(COMMANDS).alias("vocabulary"), F.create_map(*[x for k, v in shapes.items() for x in (F.lit(k), texts(v))]).alias("shapes"),
    )
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{root}/shard_metadata")
    return spark.read.parquet(f"{root}/shard_metadata")


def read(spark: SparkSession, root: str, table: str, split: str = "all", skip_corrupt: bool = False, cached: bool = False) -> DataFrame:
    """A table of shards; the split is a partition filter, never a fallback to other files.

    `cached` keeps what was read in the executors' memory, and on their disks what does not fit.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    try:
        rows = reader.parquet(f"{root}/{table}")
    except AnalysisException:
        if not skip_corrupt:
            raise
        rows = reader.option("mergeSchema", "true").parquet(f"{root}/{table}")  # the file whose schema was taken is corrupt: take all
    split = normal_split(split)
    rows = rows if split == "all" else rows.where(F.col("split") == split)
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if cached else rows


def shard_bytes(spark: SparkSession, tables: list[str]) -> DataFrame:
    """split, source_shard, bytes of the data files under the table folders; only the listing is read."""
    there = [t for t in tables if exists(spark, t)]
    if not there:
        return spark.createDataFrame([], "split string, source_shard string, bytes bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(there).select("path", "length")
    value = lambda name: F.try_url_decode(F.replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias(name)
    return files.select(value("split"), value("source_shard"), "length").groupBy("split", "source_shard").agg(F.sum("length").alias("bytes"))


def write_trajectory(nested: DataFrame, part_id: str, path: str) -> None:
    """One part's nested trajectory as a file of its own."""
    nested.where(F.col("part_id") == part_id).coalesce(1).write.mode("overwrite").parquet(path)


def bytes_written(spark: SparkSession, root: str, table: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _json_safe(name: str, kind: str) -> Column:
    """NaN and infinities have no JSON form: they become null."""
    column = F.col(name)
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if kind in ("double", "float"):
        return finite(column).alias(name)
    if kind in ("array<double>", "array<float>"):
        return F.transform(column, finite).alias(name)
    if kind == "binary":
        return F.concat(F.lit("<"), F.octet_length(column).cast("string"), F.lit(" bytes>")).alias(name)
    return column.alias(name)


def json_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): each row as JSON; binary fields show their size."""
    return rows.select(*keys, F.to_json(F.struct(*[_json_safe(n, k) for n, k in rows.dtypes])).alias("document"))


def history(states: DataFrame, actions: DataFrame) -> DataFrame:
    """Log rows of each part: step 0 is the empty start, step k the state after action k-1."""
    after = actions.select("part_id", (F.col("step") + 1).alias("step"), "operation_name")
    joined = states.join(after, ["part_id", "step"], "left")
    return joined.select("part_id", "step", F.coalesce("operation_name", F.lit("start")).alias("operation"), F.col("num_faces").alias("faces"), F.col("num_edges").alias("edges"), F.round("volume", 3).alias("volume"))


def markdown(log: DataFrame) -> DataFrame:
    """One report per part from its history rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("step", "operation", "faces", "edges", "volume")]), F.lit(" |"))
    head = F.concat(F.lit("# Part "), "part_id", F.lit("\n\n| step | operation | faces | edges | volume |\n|---|---|---|---|---|\n"))
    rows = log.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("step", line.alias("line"))))["line"].alias("lines"))
    return rows.select("part_id", F.concat(head, F.array_join("lines", "\n")).alias("report"))


def export_assets(rows: DataFrame, folder: str, key: str, assets: dict[str, str]) -> DataFrame:
    """Assets of each row as a table under `folder`, partitioned by asset name, and the row's
    JSON metadata beside it; returns (key, asset, size). Spark has no writer of single binary
    files, and a table keeps exports of many small assets readable."""
    exploded = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(name).alias("asset"), F.col(c).cast("binary").alias("content")) for name, c in assets.items()])).alias("a")).select(key, "a.asset", "a.content").where("content IS NOT NULL")
    exploded.write.mode("overwrite").partitionBy("asset").parquet(f"{folder}/assets")
    json_documents(rows, [key]).write.mode("overwrite").json(f"{folder}/metadata")
    return rows.sparkSession.read.parquet(f"{folder}/assets").select(key, "asset", F.octet_length("content").alias("size"))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
