"""The jobs: whole output against brute force, reruns, growing input, crashes between the writes."""

import json
import runpy
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import __spark_entry__
from jobs import common, conversation_samples, event_days

TURN = "conv_id long, turn long, role string, text string"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["job1_conversation_samples", "job2_event_days"])
def test_jobs_against_sql(spark, sf, duck, same_rows, name):
    found = __spark_entry__.queries()[name](spark, sf).toPandas()
    same_rows(found, duck.sql(__spark_entry__.oracle_sql()[name]).df())


# --- conversations ---------------------------------------------------------


def conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(5)]
    rows += [(2, 0, "user", None), (2, 1, "user", "")]  # null texts are empty texts
    rows += [(3, 0, "user", "a"), (3, 2, "user", "a gap")]
    rows += [(4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "user", "repeated")]
    rows += [(5, 0, None, "no role"), (6, None, "user", "no turn"), (None, 0, "user", "no id"), (7, 0, "robot", "?"), (8, 1, "user", "no start")]
    rows += [(9, t, "user", "h" * (t % 7)) for t in range(2000)]  # most of the rows
    return spark.createDataFrame(rows, TURN).withColumn("split", F.lit("clash"))


def test_conversation_samples(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    conversations(spark).repartition(3).write.parquet(source)
    config = common.defaults(conversation_samples.__file__)
    counts = conversation_samples.run(spark, source, target, config)
    statuses = {r.conv_id: r.status for r in spark.read.parquet(f"{target}/statuses").collect()}
    assert statuses == {1: "success", 2: "success", 3: "missing_turn", 4: "repeated_turn", 5: "null_field", 6: "null_field", None: "null_field", 7: "unknown_role", 8: "missing_turn", 9: "success"}
    turns = {(r.conv_id, r.turn): r for r in conversation_samples.read_turns(spark, target).collect()}
    assert len(turns) == 2007 == counts["turns_written"] and turns[2, 0].text == "" and {t.num_turns for t in turns.values()} == {5, 2, 2000}
    samples = {(r.conv_id, r.turn, r.horizon): r for r in conversation_samples.read_samples(spark, target).collect()}
    want = {(c, t, h) for c, t in turns for h in (1, 2, 3) if (c, t + h) in turns}
    assert set(samples) == want and len(want) == counts["samples_written"]
    assert all(s.next_n_chars == turns[c, s.target_turn].n_chars and s.target_turn == t + h and s.split == turns[c, t].split for (c, t, h), s in samples.items())
    before = rows_of(conversation_samples.output(spark, target))
    assert conversation_samples.run(spark, source, target, config) == counts
    assert rows_of(conversation_samples.output(spark, target)) == before


def test_conversation_samples_after_a_crash(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    conversations(spark).write.parquet(source)
    config = common.defaults(conversation_samples.__file__)
    with monkeypatch.context() as patch:
        patch.setattr(conversation_samples, "read_turns", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            conversation_samples.run(spark, source, target, config)
    counts = conversation_samples.run(spark, source, target, config)
    assert counts["turns_read"] == 2017 and counts["samples_written"] == conversation_samples.read_samples(spark, target).count()


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], TURN).write.parquet(str(tmp_path / "in"))
    counts = conversation_samples.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), common.defaults(conversation_samples.__file__))
    assert set(counts.values()) == {0} and conversation_samples.output(spark, str(tmp_path / "out")).count() == 0


# --- events ----------------------------------------------------------------


@pytest.fixture
def growing(spark, sf, tmp_path):
    """A folder of event files that grows by copies of a third of the table; the third call adds odd rows and some again."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    odd = [(None, None, None, None, None, None), (5, None, 1, "click", 1.0, None), (6, None, None, "click", float("nan"), None), (10**6, None, 3, None, float("inf"), "x")]

    def add(n):
        part = events.where(F.pmod("event_id", F.lit(3)) == n)
        if n == 2:
            timed = spark.createDataFrame(odd, EVENT).withColumn("ts", F.when(F.col("event_id") == 10**6, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")))
            part = part.unionByName(timed).unionByName(events.where("event_id % 10 = 0"))
        part.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))

    return add, str(tmp_path / "in"), str(tmp_path / "out")


def whole(spark, source, target):
    """What one run over all files at once makes."""
    event_days.run(spark, source, target, common.defaults(event_days.__file__))
    return rows_of(event_days.output(spark, target))


def test_event_days_over_growing_input(spark, growing, tmp_path, caplog):
    add, source, target = growing
    config, sizes = common.defaults(event_days.__file__) | {"files_per_batch": 1}, []
    for n in range(3):
        add(n)
        with caplog.at_level("INFO"):
            counts = event_days.run(spark, source, target, config)
        sizes.append(counts["events_read"])
        again = event_days.run(spark, source, target, config)
        assert set(again.values()) == {0}  # nothing is new
    assert sum(sizes) == spark.read.parquet(source).count() and min(sizes) > 0
    assert "new events from" in caplog.text and "summaries to" in caplog.text
    assert rows_of(event_days.output(spark, target)) == whole(spark, source, str(tmp_path / "once"))
    reasons = sorted(r.status for r in event_days.read(spark, f"{target}/op_log", event_days.OP_LOG).where("status <> 'valid'").collect())
    assert reasons == ["no_id", "no_part", "no_time"]


@pytest.mark.parametrize("lost", ["after the log", "after the days", "the mark"])
def test_event_days_after_a_crash(spark, growing, tmp_path, monkeypatch, lost):
    add, source, target = growing
    config = common.defaults(event_days.__file__)
    add(0)
    event_days.run(spark, source, target, config)
    add(2)
    real = event_days.write

    def failing(rows, path, *arguments, **options):
        real(rows, path, *arguments, **options)
        if path.endswith({"after the log": "op_log", "after the days": "days"}.get(lost, "-")):
            raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(event_days, "write", failing)
        if lost == "the mark":
            event_days.run(spark, source, target, config)
            spark.createDataFrame([], "batch long").write.mode("overwrite").parquet(f"{target}/mark")
        else:
            with pytest.raises(Exception, match="lost"):
                event_days.run(spark, source, target, config)
    add(1)
    event_days.run(spark, source, target, config)
    assert rows_of(event_days.output(spark, target)) == whole(spark, source, str(tmp_path / "once"))
    assert event_days.read(spark, f"{target}/op_log", event_days.OP_LOG).count() == spark.read.parquet(source).count()


def test_only_touched_days_are_made(spark, sf, tmp_path):
    source, target, config = str(tmp_path / "in"), str(tmp_path / "out"), common.defaults(event_days.__file__)
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.where("ts < '2024-01-10'").write.parquet(source)
    assert event_days.run(spark, source, target, config)["days_made"] == 9
    events.where("ts >= '2024-01-09' AND ts < '2024-01-12'").write.mode("append").parquet(source)
    assert event_days.run(spark, source, target, config)["days_made"] == 3


# --- command line ----------------------------------------------------------


def test_command_line(spark, sf, tmp_path, monkeypatch):
    stopped = []
    monkeypatch.setattr(SparkSession, "stop", lambda self: stopped.append(self))
    (tmp_path / "own.json").write_text(json.dumps({"horizons": [2]}))
    monkeypatch.setattr(sys, "argv", ["job", "--source", f"{sf}/conversations.parquet", "--target", str(tmp_path / "c"), "--config", str(tmp_path / "own.json")])
    runpy.run_module("jobs.conversation_samples", run_name="__main__")
    assert {r.horizon for r in conversation_samples.read_samples(spark, str(tmp_path / "c")).select("horizon").distinct().collect()} == {2}
    monkeypatch.setattr(sys, "argv", ["job", "--source", f"{sf}/events.parquet", "--target", str(tmp_path / "e")])
    runpy.run_module("jobs.event_days", run_name="__main__")
    assert event_days.output(spark, str(tmp_path / "e")).count() > 0 and len(stopped) == 2
    (tmp_path / "own.json").write_text(json.dumps({"horizon": 2}))
    with pytest.raises(KeyError):
        common.configured(spark, conversation_samples.__file__, str(tmp_path / "own.json"))
