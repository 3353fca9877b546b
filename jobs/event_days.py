"""Daily operation summaries from a growing folder of event files (incremental).

Each run takes only the event files that are new since the last one and writes under the target folder

* `op_log` by status, day and batch: the new events as operations, with command, commitment and
  measure; the status is `valid`, or tells that an event has no id, part or time;
* `days` by day: operations, commitments, measure, first and last operation of every part;
* `checkpoint`: which files a stream batch took; `mark`: the last batch that `days` has seen.

A batch is written to partitions of its own number, and the same files make the same batch, so a batch
replayed after a crash replaces what it wrote. `days` is made anew for just the days with batches
beyond the mark, from these days' operations; the mark moves last, and if a crash leaves it behind or
lost, days are made once more. So every rerun ends with the same tables. An event that is delivered
again on its day counts once, its earliest form.

    python -m jobs.event_days --source events/ --target out
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import defaults, log, main, write
from kinetrail.functions import scalar as S
from kinetrail.schema import ALIASES, COMMANDS, OTHER
from kinetrail.storage import work_path

OP_LOG = "event_id long, part_id long, ts timestamp_ntz, op_name string, cmd_id int, committed boolean, measure decimal(18,6), status string, day string, batch long"
DAYS = "part_id long, n_ops long, n_committed long, measure double, first_op string, last_op string, day string"


def operations(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Events as operations, with their status."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type")), F.col("event_type"))
    rows = events.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("part_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), name.alias("op_name"),
        F.coalesce(F.col("value").try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")).alias("measure"),
    )
    status = F.when(F.col("event_id").isNull(), "no_id").when(F.col("part_id").isNull(), "no_part").when(F.col("ts").isNull(), "no_time").otherwise("valid")
    return rows.withColumns({"cmd_id": S.command_id("op_name"), "committed": F.coalesce(S.is_commit_op("op_name"), F.lit(False)), "day": F.date_format("ts", "yyyy-MM-dd"), "status": status})


def write_batch(target: str, names: dict[str, str]):
    """The stream's sink: what a batch wrote before, if it is replayed, is replaced."""

    def sink(events: DataFrame, number: int) -> None:
        found = operations(events, names).withColumn("batch", F.lit(number).cast("long"))
        # New events are mostly of one day: rows stay in the tasks that read them.
        write(found, f"{target}/op_log", ["status", "day", "batch"], "dynamic", rebalance=False)

    return sink


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job; one that is not written yet has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def distinct_events(ops: DataFrame) -> DataFrame:
    """One row per day and event: the least by time and content."""
    content = ["ts", "part_id", "op_name", "cmd_id", "committed", "measure"]
    return ops.where("status = 'valid'").groupBy("day", "event_id").agg(F.min(F.struct(*content)).alias("op")).select("event_id", "op.*", "day")


def summaries(ops: DataFrame) -> DataFrame:
    """One row per day and part; a part may hold any share of the rows."""
    at = F.struct("ts", "event_id", "op_name")
    measure = F.sum(F.when(F.col("committed"), F.col("measure")).otherwise(0).cast("decimal(18,6)"))
    return distinct_events(ops).groupBy("day", "part_id").agg(
        F.count(F.lit(1)).alias("n_ops"), F.count_if("committed").alias("n_committed"), measure.cast("double").alias("measure"), F.min(at)["op_name"].alias("first_op"), F.max(at)["op_name"].alias("last_op"),
    )


def as_glob(path: str) -> str:
    """The path as a pattern that only it fits: a file stream takes a plain path for a folder, a pattern for files too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, config: dict[str, Any]) -> dict[str, int]:
    """Take what is new, bring the days up to date; returns and logs what was read and written."""
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_glob(source))
    stream = events.writeStream.foreachBatch(write_batch(target, config["operations"])).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    events_read = sum(p["numInputRows"] for p in stream.recentProgress)

    mark = read(spark, f"{target}/mark", "batch long").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("batch")).first().batch
    ops = read(spark, f"{target}/op_log", OP_LOG).where("status = 'valid'")
    touched = [(r.day, r.last) for r in ops.where(F.col("batch") > mark).groupBy("day").agg(F.max("batch").alias("last")).collect()]  # one row per calendar day at most
    made = 0
    if touched:
        days = F.col("day").isin([d for d, _ in touched])
        write(summaries(ops.where(days)), f"{target}/days", ["day"], "dynamic")
        made = read(spark, f"{target}/days", DAYS).where(days).count()  # from the files' footers
        spark.range(1).select(F.lit(max(b for _, b in touched)).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{target}/mark")
    counts = {"events_read": events_read, "days_made": len(touched), "summaries_written": made}
    log.info("read %s new events from %s; batches beyond %s touch %s days", events_read, source, mark, len(touched))
    log.info("wrote %s summaries to %s", made, target)
    return counts


def output(spark: SparkSession, target: str) -> DataFrame:
    """All tables as one, told apart by `kind`."""
    named = lambda df, kind: df.withColumn("kind", F.lit(kind))
    ops = read(spark, f"{target}/op_log", OP_LOG)
    valid = distinct_events(ops).withColumn("status", F.lit("valid")).unionByName(ops.where("status <> 'valid'").drop("batch"))
    found = named(valid.withColumn("measure", F.col("measure").cast("double")), "operation")
    return found.unionByName(named(read(spark, f"{target}/days", DAYS), "day"), allowMissingColumns=True)


def job2_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over the whole table into one new folder and checkpoint."""
    target, config = work_path(spark, "job2-event-days"), defaults(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", target, config)
    return output(spark, target)


def sql(names: dict[str, str]) -> str:
    """The same over the whole table at once."""
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    commands = ", ".join(f"('{a}', {COMMANDS.index(c)})" for a, c in ALIASES.items())
    return f"""
WITH ops AS (
  SELECT event_id, user_id AS part_id, ts, CASE event_type {named} ELSE event_type END AS op_name, coalesce(TRY_CAST(value AS DECIMAL(18, 6)), 0) AS measure,
    strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id IS NULL THEN 'no_id' WHEN user_id IS NULL THEN 'no_part' WHEN ts IS NULL THEN 'no_time' ELSE 'valid' END AS status
  FROM events
), known AS (
  SELECT ops.*, coalesce(c.id, {OTHER})::INT AS cmd_id, c.id IS NOT NULL AND c.op <> 'other' AS committed
  FROM ops LEFT JOIN (VALUES {commands}) c(op, id) ON c.op = lower(trim(op_name))
), log AS (
  SELECT event_id, part_id, ts, op_name, cmd_id, committed, measure, status, day FROM known WHERE status = 'valid'
  QUALIFY row_number() OVER (PARTITION BY day, event_id ORDER BY ts, part_id, op_name, cmd_id, committed, measure) = 1
), days AS (
  SELECT part_id, day, count(*)::BIGINT AS n_ops, count(*) FILTER (committed)::BIGINT AS n_committed, sum(CASE WHEN committed THEN measure ELSE 0 END)::DOUBLE AS measure,
    first(op_name ORDER BY ts, event_id) AS first_op, last(op_name ORDER BY ts, event_id) AS last_op
  FROM log GROUP BY part_id, day
)
SELECT 'operation' AS kind, * REPLACE (measure::DOUBLE AS measure) FROM log
UNION ALL BY NAME SELECT 'operation' AS kind, * REPLACE (measure::DOUBLE AS measure) FROM known WHERE status <> 'valid'
UNION ALL BY NAME SELECT 'day' AS kind, * FROM days
"""


SQL = sql(defaults(__file__)["operations"])

if __name__ == "__main__":
    main(__doc__.splitlines()[0], __file__, run)
