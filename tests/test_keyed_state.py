"""The keyed fold's calls to its state: few a batch, whatever the order; entries of waiting rows against a plain model."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from kinetrail import storage
from kinetrail.plans import reading
from kinetrail.streaming import oplog

OP = Row("part_id", "seq", "committed", "measure")


class Kept:
    """Value and map state in memory, with the calls counted."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.called(self.value), update=lambda v: self.called(setattr(self, "value", v)))

    def getMapState(self, name, key, schema):
        return SimpleNamespace(
            getValue=lambda k: self.called(self.map.get(k)), updateValue=lambda k, v: self.called(self.map.__setitem__(k, v)),
            removeKey=lambda k: self.called(self.map.pop(k)), keys=lambda: self.called(iter(sorted(self.map, reverse=True))),
        )

    def listTimers(self):
        return iter([1])

    def deleteTimer(self, at):
        pass

    registerTimer = deleteTimer


TIMES = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)


def processor(gap_ms=None, start=0):
    kept, fold = Kept(), oplog.KeyedFold(oplog.advance, start, gap_ms)
    fold.init(kept)
    return kept, fold


def test_a_batch_asks_once_for_an_entry():
    rng = random.Random(5)
    rows = [OP("p", seq, seq % 3 > 0, float(seq)) for seq in range(100)]
    rng.shuffle(rows)
    kept, fold = processor()
    out = [made for k in range(5) for made in fold.handleInputRows(("p",), iter(rows[k::5]), TIMES)]
    assert kept.calls == 10  # the fold is read and written, and the rows that wait with it
    assert [made.seq for made in out] == list(range(100)) and kept.value[2:] == (100, 0, b"")


def test_far_rows_touch_their_entries_alone():
    kept, fold = processor()
    list(fold.handleInputRows(("p",), (OP("p", seq, True, 1.0) for seq in range(1, 20 * oplog.BLOCK)), TIMES))
    assert len(kept.map) == 19
    before, kept.calls = dict(kept.map), 0
    list(fold.handleInputRows(("p",), iter([OP("p", 30 * oplog.BLOCK, True, 1.0)]), TIMES))
    assert kept.calls <= 4 and before.items() < kept.map.items()
    found = list(fold.handleInputRows(("p",), iter([OP("p", 0, True, 1.0)]), TIMES))
    assert [made.step for made in found] == list(range(1, 20 * oplog.BLOCK + 1)) and len(kept.map) == 1


def model(state, rows, chunk):
    """The same rules a row at a time over one dictionary."""
    for at in range(0, len(rows), chunk):
        for row in sorted(rows[at : at + chunk], key=lambda r: r.seq):
            if row.seq < state["next"] or row.seq in state["waiting"]:
                yield row.seq, None, row.measure, True
                continue
            state["waiting"][row.seq] = row
            yield from release(state)


def release(state):
    while state["next"] in state["waiting"]:
        row = state["waiting"].pop(state["next"])
        state["step"], state["sum"], state["next"] = state["step"] + row.committed, state["sum"] + row.committed * row.measure, row.seq + 1
        yield row.seq, state["step"], state["sum"], False


@pytest.mark.parametrize("seed", range(12))
def test_against_a_model(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(oplog, "BLOCK", rng.choice([1, 2, 5])), monkeypatch.setattr(oplog, "HELD", rng.choice([2, 3])), monkeypatch.setattr(oplog, "CHUNK", rng.choice([1, 7, 100]))
    start = rng.choice([-3, 0, 4])
    rows = [OP("p", seq, rng.random() < 0.7, float(rng.randrange(9))) for seq in range(start, 90) if rng.random() < 0.95]
    rows += rng.sample(rows, 9)
    rng.shuffle(rows) if seed % 3 else rows.sort(key=lambda r: r.seq + rng.randrange(20))
    kept, fold = processor(5, start)
    state = {"next": start, "step": 0, "sum": 0.0, "waiting": {}}
    while rows:
        n = rng.randrange(1, 30)
        batch, rows = rows[:n], rows[n:]
        found = [(m.seq, m.step, m.measure, m.late) for m in fold.handleInputRows(("p",), iter(batch), TIMES)]
        assert found == list(model(state, batch, oplog.CHUNK))
        if rng.random() < 0.3 or not rows:
            for _ in range(1 if rows else 90):
                found = [(m.seq, m.step, m.measure, m.late) for m in fold.handleExpiredTimer(("p",), TIMES, None)]
                if state["waiting"]:
                    state["next"] = min(state["waiting"])
                assert found == list(release(state))
        assert kept.value[2:4] == (state["next"], len(state["waiting"]))
    assert not kept.map and kept.value[3:] == (0, b"")


def test_entries_in_the_store(spark, tmp_path):
    """A part of many entries from its end to its start, over four runs."""
    n = 3 * oplog.BLOCK + 7
    for k in (3, 2, 1, 0):
        rows = spark.range(k, n, 4).selectExpr("'p' AS part_id", "id AS seq", "if(id % 3 = 0, 'workplane', 'extrude') AS op_name", "id + 0.5D AS measure")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = oplog.fold_keyed(spark.readStream.schema("part_id string, seq bigint, op_name string, measure double").parquet(f"{tmp_path}/in"))
        with storage.settings(spark, oplog.ROCKSDB):
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("NOT late").drop("late").collect()))
    want = sorted(map(tuple, oplog.fold_native(spark.read.parquet(f"{tmp_path}/in")).collect()))
    assert found == want and len(want) == n


def test_batches_do_not_follow_the_files(spark, sf, monkeypatch):
    paths, whole = [], reading.work_path
    monkeypatch.setattr(reading, "work_path", lambda *a: paths.append(whole(*a)) or paths[-1])
    assert reading.op_fold_keyed(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    log, _, state = paths
    assert len(spark.read.parquet(log).inputFiles()) > 5
    assert len(spark.read.text(f"{state}/commits").inputFiles()) == 5
