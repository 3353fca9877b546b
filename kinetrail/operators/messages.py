"""Message passing as gather and aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_messages(edges: DataFrame, nodes: DataFrame, message: Column, how: str = "sum", keys=("part_id", "step"), node: str = "face_idx", dst: str = "dst") -> DataFrame:
    """(keys, node, value): messages by destination; sum, or mean with degree 1 at least; 0 without messages."""
    if how not in ("sum", "mean"):
        raise NotImplementedError(f"aggregator {how}")
    got = edges.groupBy(*keys, F.col(dst).alias(node)).agg(F.sum(message).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    joined = nodes.select(*keys, node).join(got, [*keys, node], "left")
    total = F.coalesce("_sum", F.lit(0.0))
    value = total if how == "sum" else total / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    return joined.select(*keys, node, value.alias("value"))


def nn_conv(nodes: DataFrame, edges: DataFrame, weight: Column, in_dims: int, out_dims: int, how: str = "sum", residual: list[list[float]] | None = None, bias: list[float] | None = None, keys=("part_id", "step"), node: str = "face_idx") -> DataFrame:
    """h_v = sum or mean over u->v of h_u W(e), plus a linear residual and a bias.

    nodes: keys, node, h (array of in_dims). edges: keys, src, dst and what `weight` reads;
    `weight` is a flat array [in_dims * out_dims] of each edge. Products are array
    expressions; one aggregation by (destination, dimension) combines on the map side.
    """
    if how not in ("sum", "mean"):
        raise NotImplementedError(f"aggregator {how}")
    sent = edges.join(nodes.select(*keys, F.col(node).alias("src"), "h"), [*keys, "src"]).withColumn("_w", weight)
    rows = F.sequence(F.lit(0), F.lit(in_dims - 1))
    product = F.transform(F.sequence(F.lit(0), F.lit(out_dims - 1)), lambda o: F.aggregate(rows, F.lit(0.0), lambda s, i: s + F.get("h", i).cast("double") * F.get("_w", i * out_dims + o).cast("double")))
    parts = sent.select(*keys, F.col("dst").alias(node), F.posexplode(product).alias("dim", "m"))
    sums = parts.groupBy(*keys, node, "dim").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    value = F.col("m") if how == "sum" else F.col("m") / F.greatest(F.col("n"), F.lit(1))
    got = sums.groupBy(*keys, node).agg(F.sort_array(F.collect_list(F.struct("dim", value.alias("v"))))["v"].alias("got"))
    base = F.array_repeat(F.lit(0.0), out_dims)
    out = F.coalesce("got", base)
    if residual is not None:
        matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in residual])  # [out][in]
        out = F.zip_with(out, F.transform(matrix, lambda row: F.aggregate(F.zip_with("h", row, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)), lambda a, b: a + b)
    if bias is not None:
        out = F.zip_with(out, F.array(*[F.lit(float(x)) for x in bias]), lambda a, b: a + b)
    return nodes.join(got, [*keys, node], "left").select(*keys, node, out.alias("h"))


def fuse(adj: DataFrame, feature: str, keys=("part_id", "step"), tasks: int | None = None) -> DataFrame:
    """Each directed edge's feature plus that of its reverse (before any linear layer); edges meet in `tasks`, if given."""
    back = adj.select(*keys, F.col("adj_idx").alias("reverse_idx"), F.col(feature).alias("_back"))
    if tasks is not None:
        adj, back = adj.repartition(tasks, *keys, "reverse_idx"), back.repartition(tasks, *keys, "reverse_idx").hint("merge")
    return adj.join(back, [*keys, "reverse_idx"]).withColumn(feature, F.zip_with(feature, "_back", lambda a, b: a + b)).drop("_back")
