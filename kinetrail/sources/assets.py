"""Single files of samples: a sink that writes each asset under its sample's folder.

A Spark data source writer: each task attempt writes to a folder of its own and reports it; when all
tasks are done the driver renames the samples' folders into place, and if the job fails it removes
all that was staged. So a failed task or job leaves no half sample in sight, and the driver holds one
message per task. Paths are of any file system that pyarrow opens.

    spark.dataSource.register(AssetSource)
    rows.write.format("kinetrail_assets").mode("append").save(folder)    # sample, asset, content
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..storage import ship

STAGING = "_staging"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def checked(name: str) -> str:
    """A sample's or asset's name as one level of a path."""
    if not name or "/" in name or "\\" in name or name in (".", "..") or name.startswith("_"):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task attempt, with one folder per sample."""

    attempt: str
    files: int
    size: int


class AssetWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = open_folder(self.path)
        attempt = f"{folder}/{STAGING}/{self.job}/{TaskContext.get().taskAttemptId()}"
        files = size = 0
        try:
            for batch in iterator:
                for sample, asset, content in zip(*(batch.column(c).to_pylist() for c in ("sample", "asset", "content")), strict=True):
                    staged = f"{attempt}/{checked(sample)}"
                    system.create_dir(staged, recursive=True)
                    with system.open_output_stream(f"{staged}/{checked(asset)}") as out:
                        out.write(content)
                    files, size = files + 1, size + len(content)
        except BaseException:
            if system.get_file_info(attempt).type != fs.FileType.NotFound:
                system.delete_dir(attempt)
            raise
        return Written(attempt, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = open_folder(self.path)
        for message in messages:
            if message is None or not message.files:
                continue
            for sample in system.get_file_info(fs.FileSelector(message.attempt)):
                final = f"{folder}/{sample.base_name}"
                if system.get_file_info(final).type == fs.FileType.NotFound:
                    system.move(sample.path, final)
                    continue
                for asset in system.get_file_info(fs.FileSelector(sample.path)):
                    system.move(asset.path, f"{final}/{asset.base_name}")
        self._drop(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*open_folder(self.path))

    def _drop(self, system: fs.FileSystem, folder: str) -> None:
        staging = f"{folder}/{STAGING}/{self.job}"
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class AssetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kinetrail_assets"

    def schema(self) -> str:
        return "sample string, asset string, content binary"

    def writer(self, schema: object, overwrite: bool) -> AssetWriter:
        if overwrite:
            raise ValueError("assets are appended; files of the same name are replaced")
        return AssetWriter(self.options["path"])


def export_files(rows: DataFrame, folder: str, key: str, assets: dict[str, str]) -> None:
    """Each row's assets (file name -> column) as files `folder`/<key>/<name>; null columns have none."""
    spark = rows.sparkSession
    spark.dataSource.register(AssetSource)
    ship(spark)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("asset"), F.col(c).cast("binary").alias("content")) for name, c in assets.items()]))
    rows.select(F.col(key).cast("string").alias("sample"), each.alias("a")).select("sample", "a.asset", "a.content").where("content IS NOT NULL").write.format("kinetrail_assets").mode("append").save(folder)
