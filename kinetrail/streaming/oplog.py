"""Operation streams folded into states: in batch, and with keyed state over a stream.

The fold is the tracer's bookkeeping without the kernel: per part, operations in order;
committing ones advance the step and may change the tracked solid's measures.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from operator import attrgetter
from struct import Struct

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.scalar import is_commit_op
from ..operators.batching import ranged
from ..storage import ship

Step = Callable[[tuple, dict], tuple[tuple, dict]]
OUTPUT = "part_id string, seq bigint, step int, committed boolean, measure double"
MADE = Row("part_id", "seq", "step", "committed", "measure", "late")
#: What is folded so far, the next (or last) sequence number, and rows that wait for earlier ones (JSON).
STATE = "step int, measure double, seq bigint, waiting string"


def advance(state: tuple, row: dict) -> tuple[tuple, dict]:
    """One operation: a committing one adds its measure and opens the next step."""
    step, measure = state
    if row["committed"]:
        step, measure = step + 1, measure + row["measure"]
    return (step, measure), {"seq": row["seq"], "step": step, "committed": row["committed"], "measure": measure}


def _marked(ops: DataFrame, top_level: bool = True) -> DataFrame:
    """part_id, seq, committed, measure; nested calls are left out unless asked for."""
    rows = ops.where("depth = 0") if top_level and "depth" in ops.columns else ops
    return rows.select(F.col("part_id").cast("string").alias("part_id"), F.col("seq").cast("bigint").alias("seq"), is_commit_op("op_name").alias("committed"), F.coalesce(F.col("measure").cast("double"), F.lit(0.0)).alias("measure"))


def fold(ops: DataFrame, step: Step = advance) -> DataFrame:
    """The step over each part's operations in order.

    The default step is a sum, so a part of any size is folded in ranges (`fold_ranges`). Another one
    runs in Python, a row at a time, with each part as one group: such parts are small.
    """
    if step is advance:
        return fold_ranges(ops)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = (0, 0.0), []
        for row in rows.sort_values("seq").to_dict("records"):
            state, made = step(state, row)
            out.append({"part_id": row["part_id"], **made})
        return pd.DataFrame(out, columns=["part_id", "seq", "step", "committed", "measure"])

    ship(ops.sparkSession)
    return _marked(ops).groupBy("part_id").applyInPandas(run, OUTPUT)


def fold_ranges(ops: DataFrame) -> DataFrame:
    """The default step as a prefix scan in two levels: rows are cut into ranges of (part, seq), each range
    is summed up by itself, and the totals of the ranges of a part before it are added."""
    done = F.col("committed").cast("int")
    rows = ranged(_marked(ops).withColumns({"_step": done, "_add": done * F.col("measure")}), ["part_id", "seq"])
    inside = Window.partitionBy("part_id", "_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("part_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part_id", "_part").agg(F.sum("_step").alias("_steps"), F.sum("_add").alias("_sum"))
    before = totals.select("part_id", "_part", F.coalesce(F.sum("_steps").over(earlier), F.lit(0)).alias("_steps"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum"))
    running = rows.select("part_id", "_part", "seq", "committed", F.sum("_step").over(inside).alias("_step"), F.sum("_add").over(inside).alias("_add"))
    return running.join(before, ["part_id", "_part"]).select("part_id", "seq", (F.col("_steps") + F.col("_step")).cast("int").alias("step"), "committed", (F.col("_sum") + F.col("_add")).alias("measure"))


def fold_native(ops: DataFrame) -> DataFrame:
    """The default step as running windows, a part in one task: for many small parts."""
    w = Window.partitionBy("part_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = _marked(ops)
    done = F.col("committed").cast("int")
    return rows.select("part_id", "seq", F.sum(done).over(w).cast("int").alias("step"), "committed", F.sum(done * F.col("measure")).over(w).alias("measure"))


def fold_stream(ops: DataFrame, step: Step = advance, timeout: str = GroupStateTimeout.NoTimeout, start: int | None = None) -> DataFrame:
    """The same fold over a stream, with state per part.

    With `start`, sequence numbers of a part have no gaps from there on: a row that comes before its
    predecessors, in whatever micro batch, waits in the state until they are there. Without it, gaps
    are allowed, and a row that comes in a later micro batch than its successors is an error. A
    sequence number that was folded already is an error in both cases.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, measure, seq, waiting = state.get if state.exists else (0, 0.0, start, "[]")
        rows = pd.concat(list(batches)).to_dict("records") + [{"seq": s, "committed": c, "measure": m} for s, c, m in json.loads(waiting)]
        held, out, later = (count, measure), [], []
        for row in sorted(rows, key=lambda r: r["seq"]):
            if seq is not None and row["seq"] < seq + (start is None):
                raise ValueError(f"operation {row['seq']} of part {key[0]} comes after its successors or again")
            if start is not None and row["seq"] != seq:
                later.append([int(row["seq"]), bool(row["committed"]), float(row["measure"])])
                continue
            held, made = step(held, row)
            out.append({"part_id": key[0], **made})
            seq = int(row["seq"]) + (start is not None)
        state.update((int(held[0]), float(held[1]), seq, json.dumps(later)))
        yield pd.DataFrame(out, columns=["part_id", "seq", "step", "committed", "measure"])

    ship(ops.sparkSession)
    return _marked(ops).groupBy("part_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


#: Sequence numbers of one entry of waiting rows, entries held at once, and rows sorted at once.
BLOCK, HELD, CHUNK = 128, 64, 10_000
#: A waiting row in an entry: seq, committed, measure.
WAITS = Struct("<q?d")


class KeyedFold(StatefulProcessor):
    """The fold of `fold_stream` with the rows that wait for their predecessors in entries of BLOCK sequence numbers.

    A call to the state costs more than a row, so a batch asks once for each entry that its rows fall in, and for
    no other; the entry of the next number is kept with the fold itself, all others in a map. Late rows and
    rows that come again are marked, not errors.
    """

    def __init__(self, step: Step, start: int, gap_ms: int | None):
        self.step, self.start, self.gap_ms = step, start, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: What is folded so far, the next sequence number, how many rows wait, and those of its entry.
        self.folded = handle.getValueState("folded", "step int, measure double, next bigint, waiting bigint, near binary")
        self.waiting = handle.getMapState("waiting", "block bigint", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self._open(key)
        following = self.following
        while some := sorted(islice(rows, CHUNK), key=attrgetter("seq")):
            for row in some:
                seq, value = row.seq, (bool(row.committed), float(row.measure))
                if seq == self.following:
                    yield self._advance(seq, *value)
                    yield from self._released()
                elif seq < self.following or seq in (held := self._block(seq // BLOCK)):
                    yield MADE(self.part, seq, None, *value, True)
                else:
                    held[seq] = value
                    self.count += 1
                    self.changed.add(seq // BLOCK)
        if self.gap_ms is not None and (self.following != following or not list(self.handle.listTimers())):
            self._watch(timerValues)  # the time of a gap runs from when the fold came to it
        self._close()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """A gap that nothing filled in time is passed over: the fold goes on from the least row that waits."""
        self._open(key)
        if self.count:
            near = self._block(self.following // BLOCK)
            self.following = min(near or self._block(min(block for (block,) in self.waiting.keys())))
            yield from self._released()
            self._watch(timerValues)
        self._close()

    def _open(self, key: tuple) -> None:
        step, measure, self.following, self.count, near = self.folded.get() or (0, 0.0, self.start, 0, b"")
        self.part, self.held = key[0], (step, measure)
        #: Entries by number, which of them changed, which of them the map has, and whether it has any.
        self.blocks, self.changed, self.mapped = {self.following // BLOCK: _unpacked(near)}, set(), set()
        self.stored = self.count * WAITS.size > len(near)

    def _close(self) -> None:
        self._write()
        near = self.following // BLOCK
        if near in self.mapped:
            self.waiting.removeKey((near,))
        self.folded.update((int(self.held[0]), float(self.held[1]), int(self.following), int(self.count), _packed(self.blocks.get(near, {}))))

    def _block(self, block: int) -> dict[int, tuple[bool, float]]:
        """The waiting rows of one entry; read once while few others are held."""
        if block not in self.blocks:
            if len(self.blocks) >= HELD:
                self._write()
            found = self.waiting.getValue((block,)) if self.stored else None
            if found is not None:
                self.mapped.add(block)
            self.blocks[block] = {} if found is None else _unpacked(found[0])
        return self.blocks[block]

    def _write(self) -> None:
        """What changed goes back to the map, but for the entry of the next number, which is kept."""
        near = self.following // BLOCK
        for block in self.changed - {near}:
            if self.blocks[block]:
                self.waiting.updateValue((block,), (_packed(self.blocks[block]),))
                self.stored = True
            elif block in self.mapped:
                self.waiting.removeKey((block,))
        self.blocks = {n: rows for n, rows in self.blocks.items() if n == near}
        self.changed, self.mapped = self.changed & {near}, self.mapped & {near}

    def _advance(self, seq: int, committed: bool, measure: float) -> Row:
        self.held, made = self.step(self.held, {"seq": seq, "committed": committed, "measure": measure})
        self.following = seq + 1
        return MADE(self.part, made["seq"], made["step"], made["committed"], made["measure"], False)

    def _released(self) -> Iterator[Row]:
        """Rows that waited for the last one."""
        while self.count and (value := self._block(self.following // BLOCK).pop(self.following, None)):
            self.count -= 1
            self.changed.add(self.following // BLOCK)
            yield self._advance(self.following, *value)

    def _watch(self, timers: TimerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.count:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.gap_ms)


def _packed(rows: dict[int, tuple[bool, float]]) -> bytes:
    return b"".join(WAITS.pack(seq, *value) for seq, value in rows.items())


def _unpacked(data: bytes) -> dict[int, tuple[bool, float]]:
    return {seq: (committed, measure) for seq, committed, measure in WAITS.iter_unpack(data)}


#: The state store that keyed maps and timers need; without batches of no data, which timers would go on to ask for.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def fold_keyed(ops: DataFrame, step: Step = advance, start: int = 0, gap_ms: int | None = None) -> DataFrame:
    """The fold over a stream in any order, with map state: OUTPUT and `late`, which marks rows that come after
    their number was folded (or again); these have no step. Sequence numbers have no gaps from `start` on;
    with `gap_ms` a gap that stays open so long is passed over. Start the query under the ROCKSDB settings.
    """
    ship(ops.sparkSession)
    mode = "None" if gap_ms is None else "ProcessingTime"
    return _marked(ops).groupBy("part_id").transformWithState(KeyedFold(step, start, gap_ms), f"{OUTPUT}, late boolean", "Append", mode)


def windowed_histogram(ops: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Operations by event-time window and command; works on streams and tables."""
    rows = ops.withWatermark(time, late) if ops.isStreaming else ops
    return rows.groupBy(F.window(time, window).alias("w"), "cmd_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "cmd_id", "n")
