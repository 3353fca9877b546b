"""The cluster's shared work folder, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_UNSET: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _UNSET.get(spark.sparkContext.applicationId)
        if not base:
            base = _UNSET[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="kinetrail-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


#: Paths handed out inside open scopes, the innermost last.
_SCOPES: list[list[str]] = []


def work_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/kinetrail/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are deleted at the end; write the results before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a table or folder of any file system that Spark writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: a lost executor costs only a re-read."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows with at most about `each` of them: what a task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """For plans that run inside: so many rows an Arrow batch, where whole texts make batches large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; those before are restored."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clean(spark: SparkSession) -> None:
    """Delete all work tables. Results that were not written elsewhere cannot be read after that."""
    delete(spark, f"{shared_dir(spark)}/kinetrail")


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once a context: they unpickle functions by name."""
    context = spark.sparkContext
    if any(Path(f).name == "kinetrail-modules.zip" for f in context.listFiles):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinetrail-")) / "kinetrail-modules.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in package.rglob("*.py"):
            archive.write(module, module.relative_to(package.parent))
    context.addPyFile(str(target))
