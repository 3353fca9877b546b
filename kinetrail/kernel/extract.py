"""Programs to raw geometry rows, part by part with faults kept apart, then to features natively."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from multiprocessing import get_context
from multiprocessing.connection import Connection

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import scalar as S
from ..schema import CURVE_GROUPS, PROFILE, SURFACE_GROUPS, empty_states
from ..storage import ship, tasks_for, written
from . import program, solids

RAW_FACE = "face_idx:int,kind:string,area:double,centroid:array<double>,normal:array<double>,size:array<double>,num_wires:int,num_edges:int,reversed:boolean,uv_range:array<double>,inertia:array<double>,uv:array<float>"
RAW_EDGE = "edge_idx:int,kind:string,length:double,midpoint:array<double>,tangent:array<double>,closed:boolean,degenerate:boolean,faces:array<int>,u:array<float>"
RAW_ACTION = f"step:int,operation_name:string,args:array<string>,kwargs:array<struct<k:string,v:string>>,ref_kind:int,ref_entity_indices:array<bigint>,ref_points:array<array<double>>,ref_directions:array<array<double>>,profile:{PROFILE}"
RESULT = (
    "part_id string, status string, error string, duration_s double, "
    f"ops array<struct<step:int,depth:int,op_name:string,args:array<string>,kwargs:array<struct<k:string,v:string>>>>, "
    f"states array<struct<step:int,num_solids:int,volume:double,surface_area:double,bbox:array<double>,centre:array<double>,faces:array<struct<{RAW_FACE}>>,edges:array<struct<{RAW_EDGE}>>>>, actions array<struct<{RAW_ACTION}>>"
)


class _Timeout(Exception):
    pass


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _call(name: str, args: list, kwargs: list) -> dict:
    return {"args": [_text(a) for a in args], "kwargs": [{"k": k, "v": _text(v)} for k, v in kwargs]}


def _sampled(rows: list[dict], index: str, sampler: str, name: str, n: int) -> list[dict]:
    """Numbered entities with their samples as a flat list, if any are asked for."""
    return [{index: i, **{k: v for k, v in r.items() if k != sampler}, name: r[sampler](n).astype("float32").ravel().tolist() if n else None} for i, r in enumerate(rows)]


def _in_child(pipe: Connection, *arguments) -> None:
    pipe.send(_run_part(*arguments))


def run_part(code: str | None, timeout_s: float, grid: int = 0, samples: int = 0) -> tuple[str, str | None, float, list, list, list]:
    """(status, error, seconds, ops, states, actions); the limit is kept inside the task. Only the main
    thread gets signals: elsewhere a forked process runs the part and is killed at the limit."""
    if threading.current_thread() is threading.main_thread():
        return _run_part(code, timeout_s, grid, samples)
    began, forked = time.perf_counter(), get_context("fork")
    here, there = forked.Pipe(duplex=False)
    child = forked.Process(target=_in_child, args=(there, code, timeout_s, grid, samples), daemon=True)
    child.start()
    there.close()
    try:
        # The child stops itself by a signal; only one that cannot take it is killed.
        if here.poll(timeout_s * 1.1 + 1):
            return here.recv()
        return "timeout", f"timeout after {timeout_s} s", time.perf_counter() - began, [], [], []
    except EOFError:
        return "runtime_error", f"process ended with {child.exitcode}", time.perf_counter() - began, [], [], []
    finally:
        child.kill()
        child.join()
        here.close()


def _run_part(code: str | None, timeout_s: float, grid: int = 0, samples: int = 0) -> tuple[str, str | None, float, list, list, list]:
    began, old = time.perf_counter(), None
    limited = threading.current_thread() is threading.main_thread()

    def stop(*_):
        raise _Timeout(f"timeout after {timeout_s} s")

    try:
        if limited:
            old = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, timeout_s)
        chain, calls = program.parse(code or "")
        ops, states, actions, step = [], [], [], 0
        for i, (name, args, kwargs) in enumerate(calls):
            ops.append({"step": i, "depth": 0, "op_name": name} | _call(name, args, kwargs))
        for name, args, kwargs, reference, state in solids.build(chain):
            if state:
                actions.append({"step": step, "operation_name": name} | _call(name, args, kwargs) | reference)
                step += 1
                states.append({k: state[k] for k in ("num_solids", "volume", "surface_area", "bbox", "centre")} | {"step": step, "faces": _sampled(state["faces"], "face_idx", "patch", "uv", grid), "edges": _sampled(state["edges"], "edge_idx", "curve", "u", samples)})
        if time.perf_counter() - began > timeout_s:
            stop()
        return "success", None, time.perf_counter() - began, ops, states, actions
    except SyntaxError as e:
        status, error = "syntax_error", f"SyntaxError: {e}"
    except program.Unsupported as e:
        status, error = "unsupported_operation", str(e)
    except _Timeout as e:
        status, error = "timeout", str(e)
    except Exception as e:  # a part's fault is a row, never the task's
        status, error = "runtime_error", f"{type(e).__name__}: {e}"
    finally:
        if limited:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, old)
    return status, error, time.perf_counter() - began, [], [], []


#: Bytes of results that a task remembers by program.
MEMO_BYTES = 32_000_000
#: Parts of a task; results that depend on the program alone, not on the machine's load.
PARTS_A_TASK = 25_000
#: Parts whose graphs are paired in one task.
GRAPHS_A_TASK = 10_000
SETTLED = ("success", "syntax_error", "unsupported_operation")


def spread(parts: DataFrame) -> DataFrame:
    """Parts over tasks: a program is a few bytes and much work, so files alone would give too few."""
    return parts.repartition(tasks_for(parts.sparkSession, parts.count(), PARTS_A_TASK), "part_id")


class Remembered:
    """Results of programs as one-row Arrow batches; of those seen again, the latest are kept up to `size` bytes."""

    def __init__(self, schema: pa.Schema, run, size: int = MEMO_BYTES):
        self.schema, self.run, self.size = schema, run, size
        self.kept: OrderedDict[str | None, pa.RecordBatch] = OrderedDict()
        self.bytes = 0

    def of(self, code: str | None) -> pa.RecordBatch:
        found = self.kept.get(code)
        if found is not None:
            self.kept.move_to_end(code)
            return found
        values = self.run(code)
        found = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)
        if values[0] in SETTLED:
            self.kept[code] = found
            self.bytes += found.nbytes
            while self.bytes > self.size:
                self.bytes -= self.kept.popitem(last=False)[1].nbytes
        return found

    def rows(self, codes: list[str | None]) -> list[pa.Array]:
        """The results of `codes`, column by column; equal programs of the list are copied by Arrow."""
        places = {code: i for i, code in enumerate(dict.fromkeys(codes))}
        each = [self.of(code) for code in places]
        index = pa.array([places[c] for c in codes], pa.int32())
        columns = [pa.concat_arrays([b.column(i) for b in each]) for i in range(len(self.schema))]
        return columns if len(places) == len(codes) else [c.take(index) for c in columns]


def extract(parts: DataFrame, timeout_s: float = 15.0, grid: int = 0, samples: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """One result row per part; write it or persist it, then take the tables from it. Columns to `keep` follow.

    With `grid` and `samples` faces get a grid of grid x grid samples and edges so many samples.
    A result depends on the program alone, so a task runs a program that it remembers once; its
    other parts carry the duration of that run. Programs that ran out of time or failed while they
    ran are tried again for every part.
    """

    rows = parts.select(F.col("part_id").cast("string").alias("part_id"), F.col("code").cast("string").alias("code"), *keep)
    result = StructType([*_parse_datatype_string(RESULT), *[rows.schema[c] for c in keep]])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result])
    last = len(schema) - len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(pa.schema(list(schema)[1:last]), lambda code: run_part(code, timeout_s, grid, samples))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept = [c.cast(f.type) for c, f in zip(part.columns[2:], list(schema)[last:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema[0].type), *known.rows(part.column(1).to_pylist()), *kept], schema=schema)

    ship(parts.sparkSession)
    return rows.mapInArrow(run, result)


def by_program(parts: DataFrame, timeout_s: float = 15.0, grid: int = 0, samples: int = 0) -> tuple[DataFrame, DataFrame]:
    """Results of programs, written, and `parts` with the key of each one's result in the column `program`.

    Parts of equal programs share one result, whose part_id is that key, so what its tables hold is
    computed and checked once. A program that ran out of time or failed while it ran is tried again for
    every part, as in `extract`; such a part has a result of its own.
    """
    code = F.coalesce(F.col("code").cast("string"), F.lit(""))
    parts = parts.withColumn("program", F.sha2(code, 256))

    def run(rows: DataFrame) -> DataFrame:
        rows = written(rows.select(F.col("program").alias("part_id"), code.alias("code")).distinct(), "programs")
        return written(extract(spread(rows), timeout_s, grid, samples), "extracted")

    results = run(parts)
    settled = F.col("status").isin(*SETTLED)
    failed = results.where(~settled).select(F.col("part_id").alias("program"), F.lit(True).alias("_failed"))
    if failed.isEmpty():
        return results, parts
    own = F.when(F.col("_failed"), F.sha2(F.to_json(F.struct("part_id", "program")), 256)).otherwise(F.col("program"))
    parts = parts.join(failed, "program", "left").withColumn("program", own)
    return results.where(settled).unionByName(run(parts.where("_failed"))), parts.drop("_failed")


# Of all tables below, columns of the results to `keep` follow the part's key.


def _states(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return results.where("status = 'success'").select("part_id", *keep, F.explode("states").alias("s")).select("part_id", *keep, "s.*")


def states(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    s = _states(results, keep)
    return s.select("part_id", *keep, "step", F.size("faces").alias("num_faces"), F.size("edges").alias("num_edges"), "num_solids", "volume", "surface_area", F.transform("bbox", lambda x: S.nan_to_num(x).cast("float")).alias("bbox"))


def op_log(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return results.select("part_id", *keep, F.explode("ops").alias("o")).select("part_id", *keep, "o.*")


def face_edge(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    e = _states(results, keep).select("part_id", *keep, "step", F.explode("edges").alias("e"))
    return e.select("part_id", *keep, "step", F.explode(F.array_distinct("e.faces")).alias("face_idx"), F.col("e.edge_idx").alias("edge_idx"))  # a seam has one face twice


def faces(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """32 features of each face from its raw values."""
    f = _states(results, keep).select("part_id", *keep, "step", F.explode("faces").alias("f")).select("part_id", *keep, "step", "f.*")
    d = [F.get("size", F.lit(i)) for i in range(3)]
    vector = S.assemble(
        32, S.one_hot("kind", SURFACE_GROUPS, 8), [F.col("area")], F.col("centroid"), S.normalize("normal"), F.col("size"),  # normals come turned outward
        [F.col("num_wires").cast("double"), F.col("num_edges").cast("double"), F.when(F.col("reversed"), -1.0).otherwise(1.0)], F.col("uv_range"), F.col("inertia"),
        [S.log_area("area"), S.aspect(d[0], d[1]), S.aspect(d[1], d[2]), S.diagonal(*d), S.flag(F.col("kind") != "plane"), S.flag(F.col("num_wires") > 1)],
    )
    key = F.concat_ws("/", "part_id", F.col("step").cast("string"), F.lit("f"), F.col("face_idx").cast("string"))
    return f.select("part_id", *keep, "step", "face_idx", key.alias("face_key"), S.nan_to_num_array(vector).cast("array<float>").alias("features"), "uv")


def edges(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """16 features of each edge; convexity from the normals of its two faces."""
    s = _states(results, keep)
    normals = F.transform("faces", lambda f: f["normal"])
    e = s.select("part_id", *keep, "step", "centre", normals.alias("normals"), F.explode("edges").alias("e")).select("part_id", *keep, "step", "centre", "normals", "e.*")
    n = lambda i: F.coalesce(F.get("normals", F.get("faces", F.lit(i))), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    convex = S.convexity(n(0), n(1), "midpoint", "centre", F.size("faces"))
    vector = S.assemble(16, S.one_hot("kind", CURVE_GROUPS, 6), [S.symlog(F.greatest(F.lit(0.0), F.col("length")))], F.transform("midpoint", lambda x: S.squash(x)), S.normalize("tangent"), [S.flag(F.col("closed")), S.flag(F.col("degenerate")), convex])
    key = F.concat_ws("/", "part_id", F.col("step").cast("string"), F.lit("e"), F.col("edge_idx").cast("string"))
    return e.select("part_id", *keep, "step", "edge_idx", key.alias("edge_key"), S.nan_to_num_array(vector).cast("array<float>").alias("features"), "u")


def statuses(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return results.select("part_id", *keep, "status", "error", "duration_s")


def with_start(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """States of every successful part with the empty one it starts from."""
    done = results.where("status = 'success'").select("part_id", *keep)
    return empty_states(done, keep).unionByName(states(results, keep))


def actions(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The action that led from each state to the next, in the schema's form."""
    a = results.where("status = 'success'").select("part_id", *keep, F.explode("actions").alias("a")).select("part_id", *keep, "a.*")
    summary = S.action_summary("ref_points", "ref_directions", S.numeric_args("args", "kwargs"))
    a = a.withColumn("_s", summary).withColumn("_tool", F.when(S.normalize_op("operation_name").isin("union", "fuse", "intersect"), F.struct(F.get("args", F.lit(0)).alias("tool_type"))))
    floats = lambda c: F.col(c).cast("array<float>").alias(c.split(".")[-1])
    deep = lambda c: F.col(c).cast("array<array<float>>").alias(c)
    return a.select("part_id", *keep, "step", "operation_name", S.command_id("operation_name").cast("int").alias("cmd_id"), floats("_s.params_raw"), floats("_s.params"), "_s.param_mask", "ref_kind", "ref_entity_indices", deep("ref_points"), deep("ref_directions"), "profile", F.col("_tool").cast("struct<tool_type:string>").alias("tool_geometry"))


def trajectories(results: DataFrame, parts: DataFrame, key: str = "part_id") -> DataFrame:
    """One row per successful part: where it came from (split, source_shard, source_row of `parts`) and its steps.
    `key` is the column of `parts` that names their results; many parts may have one (`by_program`)."""
    done = results.where("status = 'success'").select(F.col("part_id").alias(key), F.size("states").alias("num_steps"))
    # Files of equal results are small for their rows: their size must not make the planner broadcast them.
    done = done.hint("merge") if key == "part_id" else done
    return done.join(parts.select(*dict.fromkeys([key, "part_id"]), F.col("split").alias("source_split"), "source_shard", "source_row"), key).select("part_id", "source_split", "source_shard", "source_row", "num_steps")


@udtf(returnType="step int, depth int, op_name string, args array<string>")
class ProgramOperations:
    """The operations of one program as rows; a program that fails has none."""

    def eval(self, code: str | None) -> Iterator[tuple]:
        for op in run_part(code, 15.0)[3]:
            yield op["step"], op["depth"], op["op_name"], op["args"]


def register(spark: SparkSession) -> None:
    """Make the table function `program_operations(code)` known to SQL."""
    ship(spark)
    spark.udtf.register("program_operations", ProgramOperations)
