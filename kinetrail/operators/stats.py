"""Run summaries: histograms, failure taxonomy, durations, lengths, samples of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import percent
from ..schema import STATUSES, dim_command, dim_ref_kind
from .batching import global_rank


def dense_histogram(rows: DataFrame, key: str, dim: DataFrame) -> DataFrame:
    """Counts over all keys of a dimension, zeros kept."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def command_histogram(actions: DataFrame, nonzero: bool = False) -> DataFrame:
    """Actions by command, most frequent first, ties in vocabulary order."""
    found = dense_histogram(actions, "cmd_id", dim_command(actions.sparkSession))
    return (found.where("n > 0") if nonzero else found).orderBy(F.desc("n"), "cmd_id")


def ref_kind_distribution(actions: DataFrame) -> DataFrame:
    found = dense_histogram(actions, "ref_kind", dim_ref_kind(actions.sparkSession))
    return found.withColumn("pct", percent("n", F.sum("n").over(Window.partitionBy())))


def failure_breakdown(statuses: DataFrame, status: str = "status", known: list[str] | None = None) -> DataFrame:
    """Counts and percentages of every known status and of any other that occurs."""
    spark: SparkSession = statuses.sparkSession
    counts = statuses.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(s,) for s in (STATUSES if known is None else known)], f"{status} string")
    found = listed.join(counts, status, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("pct", percent("n", F.sum("n").over(Window.partitionBy())))


def unsupported_counts(statuses: DataFrame) -> DataFrame:
    return statuses.where("status = 'unsupported_operation'").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def shards_per_split(rows: DataFrame, split: str = "split", shard: str = "source_shard") -> DataFrame:
    return rows.groupBy(split).agg(F.countDistinct(shard).alias("shards"))


def duration_stats(rows: DataFrame, duration: str = "duration_s", by: list[str] | None = None) -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation), 0 for no rows.

    Exact at any size: rows are ranked over a range partitioning, so no task holds a group, and only
    the rows at the wanted ranks, four at most of a group, meet the groups again.
    """
    by, x = list(by or []), F.col("_x")
    ranked = global_rank(rows.select(*by, F.col(duration).cast("double").alias("_x")), [*by, x.asc_nulls_last()], "_rank")
    groups = ranked.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.min("_rank").alias("_start"))
    ends = []
    for name, share in (("median", 0.5), ("p95", 0.95)):
        at = (F.col("n") - 1) * F.lit(share)
        low, high = F.floor(at), F.floor(at) + 1
        ends += [F.struct(F.lit(name).alias("name"), (F.col("_start") + p).alias("_rank"), w.alias("weight")) for p, w in ((low, high - at), (F.least(high, F.col("n") - 1), at - low))]
    wanted = groups.select(*by, "n", "mean", F.explode(F.array(*ends)).alias("e")).select(*by, "n", "mean", "e.name", F.when(F.col("n") > 0, F.col("e._rank")).alias("_rank"), "e.weight")
    met = wanted.join(ranked.select("_rank", "_x"), "_rank", "left")
    value = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("weight") * x)), F.lit(0.0)).alias(name)
    return met.groupBy(*by, "n", "mean").agg(value("median"), value("p95"))


def run_summary(statuses: DataFrame, transitions: Column) -> DataFrame:
    """Success rate and mean transitions of a successful part."""
    ok = F.col("status") == "success"
    return statuses.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("succeeded"),
        percent(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.try_divide(F.sum(F.when(ok, transitions)), F.count_if(ok)), F.lit(0.0)).alias("mean_transitions"),
    )


class RunMetrics:
    """What `run_summary` and `failure_breakdown` tell, collected by the job that writes the rows.

    Write `watch(rows, transitions)` instead of the rows, then ask; nothing is read again.
    """

    def __init__(self, known: list[str] = STATUSES):
        self.known, self.seen = known, Observation()

    def watch(self, rows: DataFrame, transitions: Column) -> DataFrame:
        ok = F.col("status") == "success"
        each = [F.count_if(F.col("status") == s).alias(f"status.{s}") for s in self.known]
        other = F.count_if(F.col("status").isNull() | ~F.col("status").isin(self.known)).alias("status.other")
        return rows.observe(self.seen, F.count(F.lit(1)).alias("attempted"), F.sum(F.when(ok, transitions.cast("double"))).alias("transitions"), *each, other)

    def summary(self) -> dict[str, float]:
        """attempted, succeeded, success_rate and mean_transitions, as `run_summary` has them."""
        seen = self.seen.get
        n, good = seen["attempted"], seen["status.success"]
        return {"attempted": n, "succeeded": good, "success_rate": 100.0 * good / n if n else 0.0, "mean_transitions": (seen["transitions"] or 0.0) / good if good else 0.0}

    def breakdown(self) -> dict[str, int]:
        """Rows of every known status, and of all others together."""
        return {s: self.seen.get[f"status.{s}"] for s in [*self.known, "other"]}


def route_by_status(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return results.where("status = 'success'"), results.where("status != 'success' OR status IS NULL")


def length_stats(parts: DataFrame, actions: DataFrame, part: str = "part_id") -> DataFrame:
    """Steps per part, parts without actions included: mean, min, max, sum."""
    counts = actions.groupBy(part).agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    return parts.select(part).join(counts, part, "left").agg(F.count(F.lit(1)).alias("parts"), F.avg(k).alias("mean_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"), F.sum(k).alias("sum_k"))


def state_stats(states: DataFrame) -> DataFrame:
    multi = F.count_if(F.col("num_solids") > 1)
    return states.agg(
        F.count(F.lit(1)).alias("states"), multi.alias("multi_solid"), percent(multi, F.count(F.lit(1))).alias("multi_solid_pct"),
        *[f(c).alias(f"{n}_{c}") for c in ("num_faces", "num_edges") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    )


def multi_reference(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count_if(F.size("ref_entity_indices") > 1).alias("multi_reference"), F.count(F.lit(1)).alias("actions"))


def wire_totals(wires: DataFrame, keys: list[str]) -> DataFrame:
    return wires.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_wires"), F.count_if("is_inner_loop").alias("num_inner_loops"), F.count_if(~F.col("is_inner_loop")).alias("num_outer_loops"), F.sum("length").alias("total_wire_length"))


def outer_wire(wires: DataFrame, keys: list[str], area: Column, index: str) -> DataFrame:
    """The wire of largest box area of each profile, ties to the lowest index; all others are inner."""
    return wires.groupBy(*keys).agg(F.max_by(F.col(index), F.struct(area, -F.col(index))).alias("outer_index"), F.max(area).alias("outer_area"))


def wires_by_area(wires: DataFrame, keys: list[str], area: Column, index: str) -> DataFrame:
    """The wires of each profile from the largest box area down, ties by index; profiles are small."""
    return wires.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct((-area).alias("a"), F.col(index).alias("i")))), lambda w: w["i"]).alias("wires"))


def classify_wires(wires: DataFrame, keys: list[str], area: Column, index: str) -> DataFrame:
    return wires.join(outer_wire(wires, keys, area, index).select(*keys, "outer_index"), keys).withColumn("is_inner_loop", F.col(index) != F.col("outer_index")).drop("outer_index")


def box_of(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")])


def surface_area(faces: DataFrame, keys: list[str], area: Column) -> DataFrame:
    return faces.groupBy(*keys).agg(F.sum(area).alias("surface_area"))


def moving_mean(rows: DataFrame, value: str, last: int, part: list[str], order: list, name: str = "moving_mean") -> DataFrame:
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(1 - last, 0)))


def running_tally(rows: DataFrame, tallies: dict[str, Column], part: list[str], order: list) -> DataFrame:
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(c).over(frame) for name, c in tallies.items()})


def progress_samples(rows: DataFrame, part: list[str], order: list, points: int = 5) -> DataFrame:
    """Every floor(n/points)-th row and the last, with its place and the number of rows."""
    w = Window.partitionBy(*part)
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    every = F.greatest(F.lit(1), F.floor(F.col("total") / points))
    return placed.where((F.col("place") % every == 0) | (F.col("place") == F.col("total")))


def mean_pool(vectors: DataFrame, keys: list[str], vector: str, dims: int | None = None) -> DataFrame:
    """Mean of each dimension by group, as (keys, dim, value).

    With a known number of dimensions rows are not multiplied before they are aggregated.
    """
    if dims:
        means = vectors.groupBy(*keys).agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dims)])
        return means.select(*keys, F.posexplode(F.array(*[f"_{i}" for i in range(dims)])).alias("dim", "value"))
    return vectors.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def mesh_volume(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Volume of closed oriented meshes: sum of signed tetrahedra, 0 at least. Rows have a, b, c as 3-vectors."""
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    cross = lambda u, v: [at(u, 1) * at(v, 2) - at(u, 2) * at(v, 1), at(u, 2) * at(v, 0) - at(u, 0) * at(v, 2), at(u, 0) * at(v, 1) - at(u, 1) * at(v, 0)]
    normal = cross("b", "c")
    signed = sum((at("a", i) * normal[i] for i in range(3)), F.lit(0.0)) / 6
    return triangles.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(signed)).alias("volume"))
