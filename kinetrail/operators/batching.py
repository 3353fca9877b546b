"""Batches of variable-size graphs by disjoint union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


@dataclass(frozen=True)
class GraphBatch:
    """Graphs of batches as one disjoint union: tables of `collate`, and sizes of each graph."""

    graphs: DataFrame
    faces: DataFrame
    edges: DataFrame
    face_adjacency: DataFrame
    face_edge: DataFrame

    @property
    def sizes(self) -> DataFrame:
        """batch_id, batch_pos, num_faces and num_adj (directed edges) of each graph."""
        return self.graphs.select("batch_id", "batch_pos", "num_faces", "num_adj")

    def reverse_ids(self) -> DataFrame:
        """batch_id, adj_idx, reverse_idx of the union's directed edges."""
        return self.face_adjacency.select("batch_id", "adj_idx", "reverse_idx")


def assign_batches(samples: DataFrame, batch_size: int, order: list, within: list[str] | None = None, shuffle_seed: int | None = None, key: str | None = None) -> DataFrame:
    """batch_id and batch_pos of every sample, the last batch kept.

    Ranks are global over `order` or, with `within`, inside each group (a shard or split), so
    that no task has to hold the order of everything. With a seed the order is a hash of `key`.
    """
    if shuffle_seed is not None:
        order = [F.xxhash64(F.col(key), F.lit(shuffle_seed)), F.col(key)]
    if within:
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
        out = samples.withColumn("_rank", rank.cast("bigint"))
    else:
        out = global_rank(samples, order, "_rank")
    return out.withColumn("batch_id", F.floor(F.col("_rank") / batch_size)).withColumn("batch_pos", (F.col("_rank") % batch_size).cast("int")).drop("_rank")


def ranged(rows: DataFrame, order: list) -> DataFrame:
    """`rows` written in order, with _part, the number of their range, and _in, their place in it.

    Equal keys, were they all the rows, are spread over ranges by a number of the row.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_tie")
    place = F.monotonically_increasing_id()  # partition number, then row number in 33 bits
    return written(ordered.withColumn("_place", place).withColumns({"_part": F.shiftright("_place", 33), "_in": F.col("_place").bitwiseAND(2**33 - 1)}).drop("_place"), "ranged")


def global_rank(rows: DataFrame, order: list, name: str) -> DataFrame:
    """0-based rank over all rows without a single-task window: a range partitioning keeps the
    order, ranks inside each partition are shifted by the counts of those before it. The sorted
    partitions are written with their row numbers, so ranking needs no further exchange."""
    placed = ranged(rows, order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    #: one row per partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def offsets(graphs: DataFrame, counts: dict[str, str], batch: str = "batch_id", pos: str = "batch_pos") -> DataFrame:
    """Exclusive prefix sums in the batch; counts: column -> name of its offset."""
    before = Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return graphs.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, name in counts.items()})


def shift(children: DataFrame, graphs: DataFrame, on: list[str], shifts: dict[str, str], batch: str = "batch_id", pos: str = "batch_pos") -> DataFrame:
    """Child rows of the batch's graphs with their indices moved; shifts: column -> offset column."""
    names = sorted({*shifts.values()})
    joined = children.join(graphs.select(*on, batch, pos, *names).hint("merge"), on)
    return joined.withColumns({c: F.col(c) + F.col(o) for c, o in shifts.items()}).drop(*names)


def batch_vector(graphs: DataFrame, count: str, batch: str = "batch_id", pos: str = "batch_pos") -> DataFrame:
    """One row per node: its graph's position (repeat-interleave)."""
    return graphs.where(F.col(count) > 0).select(batch, pos, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias("node"))


def collate(states: DataFrame, faces: DataFrame, edges: DataFrame, adjacency: DataFrame, face_edge: DataFrame, batches: DataFrame, keys=("part_id", "step")) -> dict[str, DataFrame]:
    """A batch's tables: graphs with offsets, and children with shifted indices.

    `batches` has the keys, batch_id and batch_pos; nothing is dropped from the children. The graphs are
    written once, as every child table meets them; joins are by merge: files of like rows are much smaller
    than their rows, and the planner would broadcast whole tables through the driver.
    """
    keys = list(keys)
    graphs = offsets(states.join(batches.select(*keys, "batch_id", "batch_pos").hint("merge"), keys), {"num_faces": "face_offset", "num_edges": "edge_offset"})
    adj_counts = adjacency.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_adj"))
    graphs = written(offsets(graphs.join(adj_counts.hint("merge"), keys, "left").withColumn("num_adj", F.coalesce("num_adj", F.lit(0))), {"num_adj": "adj_offset"}), "graphs")
    return {
        "graphs": graphs,
        "faces": shift(faces, graphs, keys, {"face_idx": "face_offset"}),
        "edges": shift(edges, graphs, keys, {"edge_idx": "edge_offset"}),
        "face_adjacency": shift(adjacency, graphs, keys, {"src": "face_offset", "dst": "face_offset", "edge_idx": "edge_offset", "adj_idx": "adj_offset", "reverse_idx": "adj_offset"}),
        "face_edge": shift(face_edge, graphs, keys, {"face_idx": "face_offset", "edge_idx": "edge_offset"}),
    }


def stack(samples: DataFrame, values: list[Column], batch: str = "batch_id", pos: str = "batch_pos") -> DataFrame:
    """Fixed-size columns of a batch as arrays in position order."""
    return samples.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(pos, *values))).alias("samples"))


def transition_batch(samples: DataFrame, tables: dict[str, DataFrame], batch_size: int, order: list, step: str = "step", shuffle_seed: int | None = None) -> dict:
    """Batches of transition samples (from `transitions.transitions`): the current and the next
    states' graphs as unions, and the actions stacked by position.

    `tables`: states, faces, edges, face_adjacency, face_edge. Each side's graphs are those of the
    samples' states, numbered by the sample's place; a state that several samples share is in
    each of them.
    """
    key = "_key" if shuffle_seed is not None else None
    keyed = samples.withColumn("_key", F.concat_ws("/", "part_id", step)) if key else samples
    placed = written(assign_batches(keyed, batch_size, order, shuffle_seed=shuffle_seed, key=key).drop("_key"), "placed-samples")

    def side(at: str) -> GraphBatch:
        batches = placed.select("part_id", F.col(at).alias(step), "batch_id", "batch_pos")
        names = ("states", "faces", "edges", "face_adjacency", "face_edge")
        return GraphBatch(**collate(*[tables[n] for n in names], batches))

    actions = stack(placed, [F.col("sequence")])
    return {"current": side(step), "next": side("target_step"), "actions": actions, "metadata": placed.select("batch_id", "batch_pos", "part_id", step, "target_step", "horizon", "num_steps")}
