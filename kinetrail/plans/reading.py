"""Registered queries over stored samples, raw containers, exported files and programs in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import preprocess
from ..kernel import extract
from ..operators import epochs, stats, transitions
from ..sources import assets, containers, samples, shards
from ..storage import settings, work_path, written
from ..streaming import oplog
from . import queries as q
from .queries import big, query, r, table

SAMPLES_SQL = """
s AS (
  SELECT user_id AS part_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type, round(value, 3) + 0.0::DOUBLE AS value, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS number, count(*) OVER () AS n FROM events
)"""
BATCH, SEED = 64, 7


def _stored(spark, sf_dir) -> str:
    """Users' events as stored samples; returns the folder."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("part_id"), "ts", "event_id", "event_type", r("value", 3).alias("value"))
    folder = work_path(spark, "samples")
    samples.write(transitions.number_steps(events, ["ts", "event_id"]).select("part_id", big("step").alias("step"), "event_type", "value"), folder, ["part_id", "step"])
    return folder


@query(f"WITH {SAMPLES_SQL} SELECT number::BIGINT AS number, part_id, step::BIGINT AS step, event_type, value FROM s")
def sample_numbers(spark, sf_dir):
    """Every stored sample with its number in the global order."""
    return samples.numbered(spark, _stored(spark, sf_dir))


@query(f"WITH {SAMPLES_SQL} SELECT number::BIGINT AS number, part_id, step::BIGINT AS step, event_type, value FROM s WHERE number IN (SELECT i * (SELECT count(*) FROM events) // 1000 FROM range(1000) t(i))")
def sample_lookup(spark, sf_dir):
    """A thousand samples by their numbers, as a loader asks for them; only their files are read."""
    folder = _stored(spark, sf_dir)
    n = samples.count(spark, folder)
    return samples.take(spark, folder, sorted({i * n // 1000 for i in range(1000)}) if n else [])


def _keys_sql(epoch: int) -> str:
    keys = epochs.round_keys(SEED, epoch)[::-1]
    return "[" + ", ".join(f"{{'x': 0::BIGINT, 'k': {k}::BIGINT, 'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for k, a, b in keys) + "]"


_PARTNER = "(((key.k - acc.x) % n + n) % n)"


@query(f"""
WITH {SAMPLES_SQL}, e AS (SELECT 0 AS epoch, {_keys_sql(0)} AS keys UNION ALL SELECT 1, {_keys_sql(1)}),
p AS (
  SELECT epoch, number, part_id, step, list_reduce(keys, lambda acc, key: {{'x': CASE WHEN (greatest(acc.x, {_PARTNER}) % {epochs.PRIME} * key.a + key.b) % {epochs.PRIME} < {epochs.PRIME // 2} THEN {_PARTNER} ELSE acc.x END, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}},
    {{'x': number, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}).x AS place FROM s, e
)
SELECT epoch::BIGINT AS epoch, number::BIGINT AS number, part_id, step::BIGINT AS step, place // {BATCH} AS batch_id, (place % {BATCH})::BIGINT AS batch_pos, count(*) OVER (PARTITION BY epoch, place) AS here FROM p
""")
def epoch_batches(spark, sf_dir):
    """Batches of two shuffled epochs: every sample has one place in each, which no other has (`here` is 1)."""
    folder = _stored(spark, sf_dir)
    rows, n = samples.numbered(spark, folder).select("number", "part_id", "step"), samples.count(spark, folder)
    found = [epochs.epoch_batches(rows, n, BATCH, SEED, epoch).withColumn("epoch", F.lit(epoch).cast("long")) for epoch in (0, 1)] if n else [rows.selectExpr("*", "0L AS batch_id", "0 AS batch_pos", "0L AS epoch")]
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    here = F.count(F.lit(1)).over(Window.partitionBy("epoch", "batch_id", "batch_pos"))
    return both.select("epoch", "number", "part_id", "step", "batch_id", big("batch_pos").alias("batch_pos"), here.alias("here"))


@query("SELECT status, n FROM (SELECT count(*)::BIGINT AS attempted, count(*) FILTER (p_partkey % 5 < 3)::BIGINT AS success, count(*) FILTER (p_partkey % 5 = 3)::BIGINT AS unsupported_operation, count(*) FILTER (p_partkey % 5 = 4)::BIGINT AS syntax_error, 0::BIGINT AS timeout, 0::BIGINT AS runtime_error, 0::BIGINT AS extraction_error, 0::BIGINT AS render_error, 0::BIGINT AS other FROM part) UNPIVOT (n FOR status IN (attempted, success, unsupported_operation, syntax_error, timeout, runtime_error, extraction_error, render_error, other))")
def observed_breakdown(spark, sf_dir):
    """Extraction results by status, counted by the job that writes them."""
    metrics = stats.RunMetrics()
    written(metrics.watch(extract.extract(q._programs(spark, sf_dir)), F.size("states")), "observed")
    rows = {"attempted": metrics.summary()["attempted"]} | metrics.breakdown()
    return spark.createDataFrame(list(rows.items()), "status string, n long")


@query(q.FOLD_SQL)
def op_fold_keyed(spark, sf_dir):
    """The fold with map state and timers off, over five micro batches that mix the order of every part."""
    source = work_path(spark, "op-log")
    log = q._op_stream(spark, sf_dir)
    log.repartition(5 * spark.sparkContext.defaultParallelism, F.xxhash64("part_id", "seq")).write.parquet(source)
    files = len(spark.read.schema(log.schema).parquet(source).inputFiles())
    out, state = work_path(spark, "op-states"), work_path(spark, "op-fold")
    stream = oplog.fold_keyed(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", max(1, -(-files // 5))).parquet(source), start=1)
    with settings(spark, oplog.ROCKSDB):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return q._folded(spark.read.parquet(out).where("NOT late"))


@query("""
SELECT p_partkey::VARCHAR AS part_id, CASE WHEN p_partkey % 7 <> 0 THEN 'train' ELSE 'val' END AS split, 'success' AS status, 3::BIGINT AS ops FROM part
UNION ALL SELECT NULL, 'train', 'corrupt_shard', NULL UNION ALL SELECT NULL, 'val', 'missing_column', NULL
""")
def container_scan(spark, sf_dir):
    """Raw shards as containers, with one that is no Parquet file and one without the columns: a status row each."""
    root = q._raw_parts(spark, sf_dir)
    one = spark.range(1).coalesce(1)
    one.select(F.lit("not a container").alias("value")).write.text(f"{root}/more/train")
    one.write.parquet(f"{root}/more/val")
    for split in ("train", "val"):
        _move(spark, f"{root}/more/{split}", f"{root}/data/{split}", f"planted-{split}.parquet")
    return containers.read(spark, root).select("part_id", "split", "status", big("ops_count").alias("ops"))


def _move(spark, source: str, target: str, name: str) -> None:
    """The one data file of `source` to `target` under a new name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    (found,) = [s.getPath() for s in system.listStatus(path(source)) if s.getPath().getName().startswith("part-")]
    system.rename(found, path(f"{target}/{name}"))


@query("SELECT s_suppkey::VARCHAR AS sample, 'name.txt' AS asset, octet_length(encode(s_name)) AS size, sha256(s_name) AS digest FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'place.txt', octet_length(encode(s_nationkey::VARCHAR)), sha256(s_nationkey::VARCHAR) FROM supplier WHERE s_nationkey % 2 = 0")
def asset_files(spark, sf_dir):
    """Assets of every supplier as single files, read back: their bytes are the table's."""
    folder = work_path(spark, "asset-files")
    place = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string"))
    assets.export_files(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", place.alias("place")), folder, "s_suppkey", {"name.txt": "s_name", "place.txt": "place"})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    level = lambda i: F.element_at(F.split("path", "/"), i)
    return files.select(level(-2).alias("sample"), level(-1).alias("asset"), big("length").alias("size"), F.sha2("content", 256).alias("digest"))


@query(q.ORACLE_SQL["program_ops"])
def program_ops_sql(spark, sf_dir):
    """The operation log by SQL alone: a table function makes rows of each program."""
    extract.register(spark)
    q._programs(spark, sf_dir).createOrReplaceTempView("kinetrail_programs")
    return spark.sql("SELECT o.op_name, count(*) AS n FROM kinetrail_programs p, LATERAL program_operations(p.code) o GROUP BY o.op_name")


def _reset(state: tuple, row: dict) -> tuple[tuple, dict]:
    """A committing operation adds its measure; a sum beyond 100 starts again from nothing."""
    step, measure = state
    if row["committed"]:
        step, measure = step + 1, measure + row["measure"]
        measure = 0.0 if measure > 100 else measure
    return (step, measure), {"seq": row["seq"], "step": step, "committed": row["committed"], "measure": measure}


@query(f"""
WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {q.CMD_OF_EVENT} <> 15 AS committed, value FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS seq, 0::BIGINT AS step, false AS committed, 0.0::DOUBLE AS measure FROM o WHERE seq = 1
  UNION ALL SELECT o.user_id, o.seq, f.step + o.committed::INT, o.committed, CASE WHEN NOT o.committed THEN f.measure WHEN f.measure + o.value > 100 THEN 0 ELSE f.measure + o.value END FROM f JOIN o ON o.user_id = f.user_id AND o.seq = f.seq + 1
)
SELECT user_id::VARCHAR AS part_id, seq, step, committed, round(measure, 3) + 0.0::DOUBLE AS measure FROM f WHERE seq > 0
""")
def op_fold_step(spark, sf_dir):
    """A fold with a step of its own, which no window expresses."""
    return q._folded(oplog.fold(q._op_stream(spark, sf_dir), _reset))


@query("""
SELECT p_partkey::VARCHAR AS part_id, CASE WHEN p_partkey % 7 <> 0 THEN 'train' ELSE 'val' END AS split, CASE p_partkey % 5 WHEN 3 THEN 'unsupported_operation' WHEN 4 THEN 'syntax_error' ELSE 'success' END AS status FROM part
""")
def continuous_extraction(spark, sf_dir):
    """Raw shards extracted as a stream of files, one a batch; the run after that finds nothing new."""
    root, out, checkpoint = q._raw_parts(spark, sf_dir), work_path(spark, "followed"), work_path(spark, "follow")
    for _ in range(2):
        preprocess.follow(spark, root, out, checkpoint, ["data=debug"], files_per_batch=1).awaitTermination()
    return shards.read(spark, out, "part_status").select("part_id", "split", "status")
