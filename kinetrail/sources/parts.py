"""Raw part rows from Parquet: discovery, pruned scans, row lineage, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def normal_split(split: str) -> str:
    return "val" if split == "validation" else split


def split_glob(split: str) -> str | None:
    """File pattern of a split; None for all."""
    split = normal_split(split)
    return None if split == "all" else f"*{split}*"


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Sorted Parquet files, with their bytes, directly in a folder of any file system Spark reads; [] if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((str(s.getPath()), s.getLen()) for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(".parquet"))


def sized_shards(spark: SparkSession, root: str, split: str = "all", max_shards: int | None = None) -> list[tuple[str, str, int]]:
    """(split, file, bytes) in order: <root>/data/<split> before <root>/<split>; an absent requested split is an error."""
    split = normal_split(split)
    found: list[tuple[str, str, int]] = []
    for name in SPLITS if split == "all" else (split,):
        files = _files(spark, f"{root}/data/{name}") or _files(spark, f"{root}/{name}")
        if not files and split != "all":
            raise FileNotFoundError(f"no shards of split {split} under {root}")
        found += [(name, *f) for f in files]
    return found if max_shards is None else found[:max_shards]


def find_shards(spark: SparkSession, root: str, split: str = "all", max_shards: int | None = None) -> list[tuple[str, str]]:
    """(split, file) of `sized_shards`."""
    return [(name, file) for name, file, _ in sized_shards(spark, root, split, max_shards)]


def as_text(column: Column | str) -> Column:
    """Bytes or text as text."""
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def with_lineage(raw: DataFrame, split: Column, columns: dict[str, str]) -> DataFrame:
    """The three columns with split, file and row, of a table or stream of raw files."""
    return raw.select(
        as_text(columns["part_id"]).alias("part_id"), split.alias("split"), F.col("_metadata.file_name").alias("source_shard"), F.col("_metadata.row_index").alias("source_row"),
        as_text(columns["code"]).alias("code"), F.col(columns["ops_count"]).cast("int").alias("ops_count"),
    )


COLUMNS = {"part_id": "uuid", "code": "cadquery_file", "ops_count": "cadquery_ops_count"}


def scan(spark: SparkSession, root: str, split: str = "all", max_shards: int | None = None, columns: dict[str, str] = COLUMNS, skip_corrupt: bool = False) -> DataFrame:
    """Parts of the split with file and row lineage; only the three columns are read."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    shards = find_shards(spark, root, split, max_shards)
    frames = [with_lineage(reader.parquet(*[f for s, f in shards if s == name]), F.lit(name), columns) for name in dict.fromkeys(s for s, _ in shards)]
    if not frames:
        return pool(spark, root, "train" if normal_split(split) == "all" else split, columns, skip_corrupt)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pool(spark: SparkSession, root: str, label: str, columns: dict[str, str] = COLUMNS, skip_corrupt: bool = False) -> DataFrame:
    """All files under root, however deep, as one split."""
    raw = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(root)
    return with_lineage(raw, F.lit(normal_split(label)), columns)


def full_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every column, with the lineage to join on."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("source_shard"), F.col("_metadata.row_index").alias("source_row"))


def trace_back(references: DataFrame, raw: DataFrame) -> DataFrame:
    """(source_shard, source_row) back to raw rows."""
    return references.join(raw, ["source_shard", "source_row"])


def first_parts(rows: DataFrame, limit: int | None) -> DataFrame:
    """At most so many parts over all shards, in the order of split, shard and row."""
    return rows if limit is None else rows.orderBy("split", "source_shard", "source_row").limit(limit)


def with_ids(parts: DataFrame, ids: DataFrame, key: str = "part_id", limit: int | None = None) -> DataFrame:
    found = parts.join(ids.select(key).distinct(), key, "left_semi")
    return found if limit is None else found.orderBy(key).limit(limit)
