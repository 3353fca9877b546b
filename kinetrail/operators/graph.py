"""Face graphs as relations: adjacency, reverse edges, incidence, lookups.

Keys of a state are `keys` (part_id, step by default); all joins are equi-joins on them, so
states spread over tasks and no state meets another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

KEYS = ("part_id", "step")


def incidence(face_edge: DataFrame, keys=KEYS, face: str = "face_idx", edge: str = "edge_idx") -> DataFrame:
    """Unique (face, edge) pairs of each state."""
    return face_edge.select(*keys, face, edge).distinct()


def edge_faces(face_edge: DataFrame, keys=KEYS, face: str = "face_idx", edge: str = "edge_idx") -> DataFrame:
    """Each edge's distinct incident faces, ascending."""
    return face_edge.groupBy(*keys, edge).agg(F.sort_array(F.collect_set(face)).alias("faces"))


def directed_edges(face_edge: DataFrame, keys=KEYS, face: str = "face_idx", edge: str = "edge_idx") -> DataFrame:
    """Every ordered pair of distinct faces that share an edge, with the edge.

    Faces of one edge are gathered and paired in place: one shuffle on the edge, where a
    self-join would need two and meet the skew of the edge's degree squared.
    """
    return (
        edge_faces(face_edge, keys, face, edge)
        .where(F.size("faces") > 1)
        .select(*keys, edge, "faces", F.explode("faces").alias("src"))
        .select(*keys, edge, "src", F.explode("faces").alias("dst"))
        .where("src != dst")
        .select(*keys, "src", "dst", F.col(edge).alias("edge_idx"))
    )


def adjacency(face_edge: DataFrame, keys=KEYS, face: str = "face_idx", edge: str = "edge_idx", reverse: bool = True, tasks: int | None = None) -> DataFrame:
    """Directed edges with their dense index in (src, dst, edge) order, and the reverse edge's.

    Both directions of an edge are always there, so the reverse edge's index is the rank in
    (dst, src, edge) order: a second sort of the same partitions instead of a self-join.
    With `tasks` the incidence is spread over so many by state, and pairs are made where their state is:
    one shuffle of narrow rows, and a task holds no more in a larger table. Without, edges are gathered
    first, then states.
    """
    if tasks is not None:
        face_edge = face_edge.select(*keys, face, edge).repartition(tasks, *keys)
    pairs = directed_edges(face_edge, keys, face, edge)
    state = Window.partitionBy(*keys)
    dense = pairs.withColumn("adj_idx", F.row_number().over(state.orderBy("src", "dst", "edge_idx")) - 1)
    return dense.withColumn("reverse_idx", F.row_number().over(state.orderBy("dst", "src", "edge_idx")) - 1) if reverse else dense


def with_reverse(adj: DataFrame, keys=KEYS, simple: bool = False, missing: Column | None = None) -> DataFrame:
    """Index of the edge (dst, src, edge) in any set of directed edges; itself if there is none.

    simple: by (dst, src) only, of parallel edges the last, and 0 (or `missing`) if there is none.
    """
    if simple:
        # Parallel edges of both directions meet in a window inside their state: nothing is joined or computed twice.
        src, dst = F.col("src"), F.col("dst")
        both = Window.partitionBy(*keys, F.least(src, dst), F.greatest(src, dst))
        latest = lambda direction: F.max(F.when(direction, F.col("adj_idx"))).over(both)
        there = reduce(Column.__and__, [F.col(k).isNotNull() for k in (*keys, "src", "dst")])
        other = F.when(src < dst, latest(src > dst)).when(src > dst, latest(src < dst)).otherwise(latest(src == dst))
        return adj.withColumn("reverse_idx", F.coalesce(F.when(there, other), F.lit(0) if missing is None else missing))
    on = [*keys, "src", "dst", "edge_idx"]
    back = adj.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_idx", F.col("adj_idx").alias("reverse_idx"))
    default = F.col("adj_idx") if missing is None else missing
    return adj.join(back, on, "left").withColumn("reverse_idx", F.coalesce("reverse_idx", default))


def undirected(adj: DataFrame) -> DataFrame:
    """One row per pair of directed edges."""
    return adj.where("adj_idx < reverse_idx")


def gather_edges(adj: DataFrame, edges: DataFrame, keys=KEYS) -> DataFrame:
    """Edge features on directed edges; joined when needed, never stored."""
    return adj.join(edges, [*keys, "edge_idx"])


def gather_nodes(adj: DataFrame, nodes: DataFrame, node: str, value: str, keys=KEYS) -> DataFrame:
    """`value` of both ends of each directed edge, as src_<value> and dst_<value>."""
    side = lambda end: nodes.select(*keys, F.col(node).alias(end), F.col(value).alias(f"{end}_{value}"))
    return adj.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])


def match_faces(selected: DataFrame, faces: DataFrame, keys=KEYS) -> DataFrame:
    """Selected faces to the previous state's faces by key: first match, else index 0 and matched false."""
    first = faces.groupBy(*keys, "face_key").agg(F.min("face_idx").alias("_idx"))
    found = selected.join(first, [*keys, "face_key"], "left")
    return found.withColumn("matched", F.col("_idx").isNotNull()).withColumn("ref_entity_idx", F.coalesce("_idx", F.lit(0))).drop("_idx")


def match_edges(selected: DataFrame, edges: DataFrame, face_edge: DataFrame, keys=KEYS) -> DataFrame:
    """Selected edges to edge indices and their first incident face (0 if there is none)."""
    first = edges.groupBy(*keys, "edge_key").agg(F.min("edge_idx").alias("edge_idx"))
    host = face_edge.groupBy(*keys, "edge_idx").agg(F.min("face_idx").alias("_face"))
    found = selected.join(first, [*keys, "edge_key"], "left").join(host, [*keys, "edge_idx"], "left")
    return found.withColumn("matched", F.col("edge_idx").isNotNull()).withColumn("ref_entity_idx", F.coalesce("_face", F.lit(0))).drop("_face")


def nearest_ancestor(nodes: DataFrame, has_reference: Column) -> DataFrame:
    """For each node (node, parent) the nearest node on its way up that satisfies `has_reference`.

    Pointers of open nodes jump twice as far each round, so the longest way up costs its logarithm
    in joins; rounds end once no pointer is open, and each round's table ends the lineage. A pointer
    still open after more steps than there are nodes is on a cycle, which is an error.
    """
    marked = nodes.select("node", "parent", has_reference.alias("_hit"))
    state = marked.select("node", F.when(F.col("_hit"), F.col("node")).alias("found"), F.when(~F.col("_hit"), F.col("parent")).alias("up"), F.lit(0).alias("depth"), F.lit(1).alias("step"))
    reach, most = 1, None
    while True:
        hop = state.select(F.col("node").alias("up"), F.col("found").alias("_found"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("step").alias("_step"))
        met = state.join(hop, "up", "left")
        state = met.select(
            "node",
            F.coalesce("found", "_found").alias("found"),
            F.when(F.col("found").isNull() & F.col("_found").isNull(), F.col("_up")).alias("up"),
            F.when(F.col("found").isNotNull(), F.col("depth")).when(F.col("_found").isNotNull(), F.col("step") + F.col("_depth")).otherwise(0).alias("depth"),
            (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"),
        )
        state = written(state, "ancestors")
        if state.where("up IS NOT NULL").isEmpty():
            break
        reach *= 2
        most = state.count() if most is None else most
        if reach > most:
            raise ValueError("parents form a cycle")
    return state.select("node", F.col("found").alias("ancestor"), F.when(F.col("found").isNotNull(), F.col("depth")).alias("depth"))


def topology_counts(entities: DataFrame, keys=KEYS, tasks: int | None = None) -> DataFrame:
    """Distinct entities of each kind, from rows (keys, kind, entity_key); with `tasks`, counted where so many by state hold them."""
    if tasks is not None:
        entities = entities.repartition(tasks, *keys)
    return entities.groupBy(*keys, "kind").agg(F.countDistinct("entity_key").alias("n"))
