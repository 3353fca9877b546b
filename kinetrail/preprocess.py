"""Offline extraction from raw parts to shards, as the configuration says."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import compose
from .functions.scalar import split_alias
from .kernel import extract
from .operators import graph, stats
from .sources import parts, shards
from .storage import rows_per_batch, scope, tasks_for, written

log = logging.getLogger(__name__)


#: What every table of extracted parts carries of the raw rows.
LINEAGE = [*shards.PARTITIONS, "source_row"]


def tables_of(results: DataFrame, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the extracted parts, each with split and source_shard. Results that carry these are
    joined with nothing, and only their adjacency is shuffled; others take them from `rows`."""
    keep = shards.PARTITIONS
    if rows is not None and not {*LINEAGE} <= {*results.columns}:
        results = results.join(rows.select("part_id", *LINEAGE), "part_id")
    incidence = extract.face_edge(results, keep)
    done = results.where("status = 'success'")
    return {
        "op_log": extract.op_log(results, keep),
        "states": extract.with_start(results, keep),
        "faces": extract.faces(results, keep),
        "edges": extract.edges(results, keep),
        "face_edge": incidence,
        "face_adjacency": graph.adjacency(incidence, [*graph.KEYS, *keep], tasks=tasks_for(results.sparkSession, results.count(), extract.GRAPHS_A_TASK)),
        "actions": extract.actions(results, keep),
        "part_status": extract.statuses(results, keep),
        "trajectories": done.select("part_id", F.col("split").alias("source_split"), "source_row", F.size("states").alias("num_steps"), *keep),
    }


def run(spark: SparkSession, root: str, out: str, overrides: list[str] | None = None) -> DataFrame:
    """Extract the parts under `root` that are not in `out` yet; return the shards' metadata.

    Part keys are taken to be unique. Work tables are deleted at the end.
    """
    config = compose(overrides)
    job = config["preprocess"]
    with scope(spark), rows_per_batch(spark, 64):  # a part's grids are some 100 KB
        rows = parts.first_parts(parts.scan(spark, root, job["split"], job["max_shards"], skip_corrupt=True), job["max_parts"])
        rows = written(shards.pending(rows, out, job["overwrite"]), "pending-parts")
        if rows.isEmpty():
            return spark.read.parquet(f"{out}/shard_metadata")
        return _write(rows, out, config)


def _write(rows: DataFrame, out: str, config: dict[str, Any]) -> DataFrame:
    """Extract `rows` and write the shards they come from; each is replaced whole."""
    job, data = config["preprocess"], config["data"]
    metrics = stats.RunMetrics()
    extracted = extract.extract(extract.spread(rows), job["timeout_s"], data["uv_grid"], data["curve_samples"], LINEAGE)
    results = written(metrics.watch(extracted, F.size("states")), "extracted")
    log.info("extracted %s; by status: %s", metrics.summary(), metrics.breakdown())
    return shards.write(tables_of(results), results.select(*shards.PARTITIONS, "status"), out, data["uv_grid"], data["curve_samples"])


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, overrides: list[str] | None = None, files_per_batch: int = 8, columns: dict[str, str] = parts.COLUMNS) -> StreamingQuery:
    """Extract raw shards as they arrive under <root>/data/<split>: those not taken before, then stop.

    A shard is one file, so a micro batch holds shards whole, and the same files make the same batch. What
    a batch wrote before a crash is replaced shard by shard when it is replayed: nothing is there twice.
    """
    config = compose(overrides)
    folders = f"{root}/data/*"
    raw = spark.readStream.schema(spark.read.parquet(folders).schema).option("maxFilesPerTrigger", files_per_batch).parquet(folders)
    split = split_alias(F.element_at(F.split("_metadata.file_path", "/"), -2))
    arrived = parts.with_lineage(raw, split, columns)

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        with scope(session), rows_per_batch(session, 64):
            rows = written(batch, "arrived-parts")
            if not rows.isEmpty():
                _write(rows, out, config)

    return arrived.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
