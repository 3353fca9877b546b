"""Constraints as violation rows (entity, rule, detail); an empty result means valid.

The checks that a schema already fixes (required fields, types) become null checks; shapes
become counts of children against the parent's numbers; bounds become anti joins or filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import all_finite, symexp, symlog
from ..schema import BLANK_PIXEL, COMMANDS, PARAMS, SCHEMA_VERSION

STATE = ["part_id", "step"]
REQUIRED = {
    "states": ["part_id", "step", "num_faces", "num_edges", "num_solids", "volume", "surface_area", "bbox"],
    "actions": ["cmd_id", "params_raw", "params", "param_mask", "ref_kind", "ref_entity_indices", "ref_points", "ref_directions", "operation_name"],
    "trajectories": ["part_id", "source_split", "source_shard", "source_row", "num_steps"],
}


def _entity(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def check(rows: DataFrame, keys: list[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: name -> (violated, detail). One pass; null conditions count as violated."""
    return rows.select(_entity(keys).alias("entity"), F.explode(_violated(rules)).alias("v")).select("entity", "v.rule", "v.detail")


def missing(rows: DataFrame, keys: list[str], required: list[str], rule: str) -> DataFrame:
    return check(rows, keys, {f"{rule}.{c}": (F.col(c).isNull(), F.lit(c)) for c in required})


def count_mismatch(parents: DataFrame, expected: str, children: DataFrame, rule: str, keys=STATE) -> DataFrame:
    n = children.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return check(parents.join(n, keys, "left"), keys, {rule: (F.coalesce("_n", F.lit(0)) != F.col(expected), F.concat_ws("!=", F.coalesce("_n", F.lit(0)).cast("string"), F.col(expected).cast("string")))})


def array_rules(column: str, size: int, rule: str) -> dict[str, tuple[Column, Column]]:
    """Fixed length and finite entries, as rules for `check`."""
    return {f"{rule}.shape": (F.size(column) != size, F.size(column)), f"{rule}.finite": (~all_finite(column), F.lit(column))}


def out_of_bounds(children: DataFrame, index: str, parents: DataFrame, size: str, rule: str, keys=STATE) -> DataFrame:
    """Indices outside [0, size), children without a parent included."""
    joined = children.join(parents.select(*keys, F.col(size).alias("_size")), list(keys), "left")
    return check(joined, [*keys, index], {rule: ((F.col(index) < 0) | (F.col(index) >= F.col("_size")), F.col(index))})


def dangling(children: DataFrame, parents: DataFrame, on: list[str], rule: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(*on).distinct(), on, "left_anti").select(_entity(on).alias("entity"), F.lit(rule).alias("rule"), F.lit("no parent").alias("detail"))


def states(states: DataFrame, faces: DataFrame, edges: DataFrame, adjacency: DataFrame, face_edge: DataFrame, images: DataFrame | None = None, grid: int = 16, samples: int = 16, tasks: int | None = None) -> DataFrame:
    """All rules of a state and its children; each table is scanned once.

    Rules that one row decides are checked where the row is read, so that only keys, indices and their
    outcomes are shuffled, once. The rows of a state then meet in windows, which bring counts and
    bounds to every row and an edge's outcome to its adjacency, and the other rules are checked; with
    `tasks`, in so many.
    """
    mask = F.slice("uv", 6 * grid * grid + 1, grid * grid)
    features = array_rules("features", 16, "edges.features")
    bad = lambda name: F.coalesce(features[f"edges.features.{name}"][0], F.lit(True))
    required = {f"state.required.{c}": (F.col(c).isNull(), F.lit(c)) for c in REQUIRED["states"]}
    rows = reduce(DataFrame.unionByName, [
        _rows(states, "state", [], required, _faces="num_faces", _edges="num_edges"),
        _rows(faces, "face", ["face_idx"], array_rules("features", 32, "faces.features") | array_rules("uv", 7 * grid * grid, "faces.uv") | {"uv_mask.binary": (~F.forall(mask, lambda x: x.isin(0.0, 1.0)), F.lit("mask"))}),
        _rows(edges, "edge", ["edge_idx"], features | array_rules("u", 6 * samples, "edges.u"), _edge="edge_idx", _shape=bad("shape").cast("bigint"), _finite=bad("finite").cast("bigint"), _size=F.size("features")),
        _rows(adjacency, "adjacency", ["adj_idx"], {}, _src="src", _dst="dst", _edge="edge_idx", _reverse="reverse_idx"),
        _rows(face_edge, "incidence", ["face_idx", "edge_idx"], {}, _src="face_idx", _dst="edge_idx"),
    ])
    rows = rows.repartition(*STATE) if tasks is None else rows.repartition(tasks, *STATE)
    here = F.col("part_id").isNotNull() & F.col("step").isNotNull()  # rows without a key have no relatives
    state, edge, is_a = Window.partitionBy(*STATE), Window.partitionBy(*STATE, "_edge"), lambda table: F.col("_table") == table
    children = lambda table: F.when(here, F.count_if(is_a(table)).over(state)).otherwise(0)
    of_edge = lambda x: F.when(here & F.col("_edge").isNotNull(), F.max(F.when(is_a("edge"), x)).over(edge))
    rows = rows.withColumns({"_there": of_edge(F.lit(1)), "_no_shape": of_edge(F.col("_shape")), "_no_finite": of_edge(F.col("_finite")), "_features": of_edge(F.col("_size"))})
    rows = rows.withColumns({"_f": children("face"), "_e": children("edge"), "_directed": F.count_if(is_a("adjacency")).over(state), **{f"{c}_of": F.when(here, F.max(c).over(state)) for c in ("_faces", "_edges")}})

    differ = lambda a, b: (F.col(a) != F.col(b), F.concat_ws("!=", F.col(a).cast("string"), F.col(b).cast("string")))
    outside = lambda index, size: ((F.col(index) < 0) | (F.col(index) >= F.col(size)), F.col(index))
    there = F.col("_there").isNotNull()
    related = {
        "state": {"faces.count": differ("_f", "_faces"), "edges.count": differ("_e", "_edges")},
        "adjacency": {
            "adjacency.src": outside("_src", "_faces_of"), "adjacency.dst": outside("_dst", "_faces_of"), "adjacency.edge": outside("_edge", "_edges_of"),
            "adjacency.reverse": (outside("_reverse", "_directed")[0], F.coalesce(F.col("_reverse").cast("string"), F.lit("no reverse index"))),
            "adjacency.features": (~there, F.lit("no parent")), "adjacency.features.shape": (there & (F.col("_no_shape") == 1), F.col("_features")), "adjacency.features.finite": (there & (F.col("_no_finite") == 1), F.lit("features")),
        },
        "incidence": {"incidence.face": outside("_src", "_faces_of"), "incidence.edge": outside("_dst", "_edges_of")},
    }
    more = [F.when(is_a(table), _violated(rules)).otherwise(F.array().cast(FOUND)) for table, rules in related.items()]
    parts = [rows.select(F.col("_entity").alias("entity"), F.explode(F.concat("_found", *more)).alias("v")).select("entity", "v.rule", "v.detail")]
    if images is not None:
        views = images.groupBy(*STATE).agg(F.countDistinct("view").alias("n"), F.min(F.octet_length("pixels")).alias("low"), F.max(F.octet_length("pixels")).alias("high"))
        parts.append(check(states.join(views, STATE, "left"), STATE, {"images.shape": ((F.col("n") != 4) | (F.col("low") != F.col("high")) | (F.col("low") % 3 != 0), F.col("n"))}))
    return reduce(DataFrame.unionByName, parts)


FOUND = "array<struct<rule:string,detail:string>>"
#: What rows of a state bring to its windows, by table.
_BROUGHT = ("_faces", "_edges", "_edge", "_shape", "_finite", "_size", "_src", "_dst", "_reverse")


def _violated(rules: dict[str, tuple[Column, Column]]) -> Column:
    """The violated rules of a row; null conditions count as violated."""
    if not rules:
        return F.array().cast(FOUND)
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (bad, detail) in rules.items()])
    return F.filter(found, lambda v: v.isNotNull()).cast(FOUND)


def _rows(rows: DataFrame, table: str, index: list[str], rules: dict[str, tuple[Column, Column]], **brought: Column | str) -> DataFrame:
    value = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    return rows.select(*STATE, F.lit(table).alias("_table"), _entity([*STATE, *index]).alias("_entity"), _violated(rules).alias("_found"), *[value(brought.get(c)).cast("bigint").alias(c) for c in _BROUGHT])


def actions(actions: DataFrame) -> DataFrame:
    keys = ["part_id", "step"]
    m = F.size("ref_entity_indices")
    threes = lambda c: (F.size(c) == m) & F.forall(c, lambda p: F.size(p) == 3)
    rules = {
        "action.cmd_id": ((F.col("cmd_id") < 0) | (F.col("cmd_id") >= len(COMMANDS)), F.col("cmd_id")),
        **{f"action.{c}.shape": (F.size(c) != PARAMS, F.size(c)) for c in ("params_raw", "params", "param_mask")},
        "action.params.finite": (~all_finite("params"), F.lit("params")),
        "action.references": (~(threes("ref_points") & threes("ref_directions")), m),
    }
    return missing(actions, keys, REQUIRED["actions"], "action.required").unionByName(check(actions, keys, rules))


def trajectories(trajectories: DataFrame, states: DataFrame, actions: DataFrame) -> DataFrame:
    """Required fields, and one state more than actions, which num_steps counts."""
    return lineage(trajectories).unionByName(causal(trajectories, states, actions))


def lineage(trajectories: DataFrame) -> DataFrame:
    """The rules that a trajectory's own row decides: required fields."""
    return missing(trajectories, ["part_id"], REQUIRED["trajectories"], "trajectory.required")


def causal(trajectories: DataFrame, states: DataFrame, actions: DataFrame) -> DataFrame:
    """The rules between a trajectory's steps (part_id, num_steps), states and actions."""
    count = lambda rows, name: rows.groupBy("part_id").agg(F.count(F.lit(1)).alias(name))
    joined = trajectories.join(count(states, "_s").hint("merge"), "part_id", "left").join(count(actions, "_a").hint("merge"), "part_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_s", "_a")})
    rules = {"trajectory.causal": (F.col("_s") != F.col("_a") + 1, F.concat_ws("/", F.col("_s").cast("string"), F.col("_a").cast("string"))), "trajectory.num_steps": (F.col("num_steps") != F.col("_a"), F.col("num_steps"))}
    return check(joined, ["part_id"], rules)


def shards(metadata: DataFrame) -> DataFrame:
    return check(metadata, ["source_shard"], {"shard.version": (F.col("schema_version") != SCHEMA_VERSION, F.col("schema_version"))})


def empty_start(states: DataFrame) -> DataFrame:
    """S_0 is empty: no topology, volume, area or box (nothing of the finished part leaks into it)."""
    zero = {f"s0.{c}": (F.col(c) != 0, F.col(c)) for c in ("num_faces", "num_edges", "num_solids", "volume", "surface_area")}
    return check(states.where("step = 0"), ["part_id"], zero | {"s0.bbox": (~F.forall("bbox", lambda x: x == 0), F.lit("bbox"))})


def blank_start(images: DataFrame) -> DataFrame:
    """Every pixel of S_0's images has the blank value."""
    blank = F.length(F.replace(F.hex("pixels"), F.lit(f"{BLANK_PIXEL:02X}"), F.lit(""))) == 0
    return check(images.where("step = 0"), ["part_id", "view"], {"s0.canvas": (~blank, F.lit("pixels"))})


def symlog_round_trip(rows: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    back = symexp(symlog(value))
    return check(rows, keys, {"symlog.round_trip": (F.abs(back - F.col(value)) >= eps * F.greatest(F.lit(1.0), F.abs(F.col(value))), back)})


def batch(tables: dict[str, DataFrame]) -> DataFrame:
    """A collated batch: children inside the batch's totals, one face row per counted face."""
    totals = tables["graphs"].groupBy("batch_id").agg(F.sum("num_faces").alias("num_faces"), F.sum("num_edges").alias("num_edges"))
    bounds = lambda t, c, n: out_of_bounds(tables[t], c, totals, n, f"batch.{t}.{c}", ["batch_id"])
    return reduce(DataFrame.unionByName, [count_mismatch(totals, "num_faces", tables["faces"], "batch.faces", ["batch_id"]), bounds("face_adjacency", "src", "num_faces"), bounds("face_adjacency", "dst", "num_faces"), bounds("face_adjacency", "edge_idx", "num_edges"), bounds("face_edge", "face_idx", "num_faces"), bounds("face_edge", "edge_idx", "num_edges")])
