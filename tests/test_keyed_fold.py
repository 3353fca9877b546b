"""The keyed fold over micro batches: any order, late and repeated rows, gaps, restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import stats
from kinetrail.storage import settings, written
from kinetrail.streaming import oplog

OPS = "part_id string, seq bigint, op_name string, measure double"


@pytest.fixture
def run(spark, tmp_path):
    """Adds the rows as one more file, runs what is new from the checkpoint, returns all output so far."""

    def one(rows, gap_ms=None):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = oplog.fold_keyed(spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), start=0, gap_ms=gap_ms)
        with settings(spark, oplog.ROCKSDB):
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.part_id, r.seq, r.step, r.measure) for r in spark.read.parquet(str(tmp_path / "out")).where("NOT late").collect())

    one.late = lambda: sorted((r.part_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).where("late").collect())
    return one


def op(part, seq, measure=1.0, name="extrude"):
    return (part, seq, name, measure)


def test_any_order_with_restarts(spark, run):
    rng = random.Random(2)
    rows = [op(f"p{k}", seq, float(seq + k), "extrude" if seq % 3 else "workplane") for k in range(4) for seq in range(25)]
    want = sorted((r.part_id, r.seq, r.step, r.measure) for r in oplog.fold_native(spark.createDataFrame(rows, OPS)).collect())
    rng.shuffle(rows)
    for k in range(4):
        found = run(rows[k::4])
    assert found == want and run.late() == []


def test_late_and_repeated_rows_are_marked(run):
    run([op("a", 0), op("a", 1), op("a", 3)])
    assert run([op("a", 1), op("a", 3, 7.0), op("b", 0)]) == [("a", 0, 1, 1.0), ("a", 1, 2, 2.0), ("b", 0, 1, 1.0)]
    assert run([op("a", 2)])[2:4] == [("a", 2, 3, 3.0), ("a", 3, 4, 4.0)]  # the first 3 waited
    assert run.late() == [("a", 1), ("a", 3)]


def test_open_gaps_are_passed_over(run):
    assert run([op("a", 0), op("a", 2), op("a", 3), op("a", 6)], gap_ms=200) == [("a", 0, 1, 1.0)]
    time.sleep(0.5)
    found = run([op("b", 0)], gap_ms=200)  # the timer ends with the next batch
    assert ("a", 2, 2, 2.0) in found and ("a", 3, 3, 3.0) in found and ("a", 6, 4, 4.0) not in found
    time.sleep(0.5)
    assert ("a", 6, 4, 4.0) in run([op("b", 1), op("a", 1)], gap_ms=200) and run.late() == [("a", 1)]


def test_metrics_of_a_write(spark):
    rows = spark.createDataFrame([("success", 4), ("success", 2), ("timeout", 9), ("odd", 1), (None, 1)], "status string, k int")
    metrics = stats.RunMetrics()
    table = written(metrics.watch(rows, F.col("k")), "watched")
    summary = stats.run_summary(table, F.col("k")).first().asDict()
    assert metrics.summary() == {k: summary[k] for k in ("attempted", "succeeded", "success_rate", "mean_transitions")}
    assert metrics.breakdown()["timeout"] == 1 and metrics.breakdown()["other"] == 2 and metrics.breakdown()["syntax_error"] == 0
