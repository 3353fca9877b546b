"""Transition samples over ordered steps: pairs, action sequences, deltas, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ("part_id",)


def number_steps(rows: DataFrame, order: list, part=PART, name: str = "step") -> DataFrame:
    """0-based position of each row in its part."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)


def horizon_of(horizon) -> int:
    return max(1, int(horizon))


def pairs(states: DataFrame, values: list[str], horizon: int = 1, part=PART, step: str = "step") -> DataFrame:
    """(S_t, S_t+H) of every part: `values` and next_<values>, target_step, horizon, num_steps."""
    horizon = horizon_of(horizon)
    ordered = Window.partitionBy(*part).orderBy(step)
    later = F.lead(F.struct(step, *values), horizon).over(ordered)
    out = states.withColumn("_next", later).withColumn("num_steps", F.count(F.lit(1)).over(Window.partitionBy(*part)) - 1)
    return out.where("_next IS NOT NULL").select(*part, step, *values, F.col(f"_next.{step}").alias("target_step"), *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values], F.lit(horizon).alias("horizon"), "num_steps")


def transition_index(states: DataFrame, horizon: int = 1, part=PART, step: str = "step", max_samples: int | None = None) -> DataFrame:
    """Every (part, t) with t + H in the part; capped in (part, t) order."""
    found = pairs(states, [], horizon, part, step)
    return found if max_samples is None else found.orderBy(*part, step).limit(max_samples)


def action_sequences(actions: DataFrame, value: Column, horizon: int, part=PART, step: str = "step") -> DataFrame:
    """The H actions from each step on, for steps that have as many."""
    frame = Window.partitionBy(*part).orderBy(step).rowsBetween(0, horizon_of(horizon) - 1)
    return actions.withColumn("sequence", F.collect_list(value).over(frame)).where(F.size("sequence") == horizon_of(horizon)).select(*part, step, "sequence")


def transitions(states: DataFrame, actions: DataFrame, state_values: list[str], action_values: list[str], horizon: int = 1, max_samples: int | None = None, part=PART) -> DataFrame:
    """Samples (current state, H actions, next state) with their metadata."""
    steps = pairs(states, state_values, horizon, part)
    sequences = action_sequences(actions, F.struct(*action_values), horizon, part)
    samples = steps.join(sequences.hint("merge"), [*part, "step"]).withColumn("action", F.get("sequence", F.lit(0)))
    return samples if max_samples is None else samples.orderBy(*part, "step").limit(max_samples)


def trajectories(states: DataFrame, actions: DataFrame, part=PART) -> DataFrame:
    """Nested form: num_steps, states and actions in step order."""
    nested = lambda rows, name: rows.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("step", *[c for c in rows.columns if c not in (*part, "step")]))).alias(name))
    joined = nested(states, "states").join(nested(actions, "actions"), list(part), "left")
    return joined.withColumn("num_steps", F.coalesce(F.size("actions"), F.lit(0)))


def delta(vector: str, later: str) -> Column:
    return F.zip_with(F.col(later), F.col(vector), lambda b, a: b - a)


def with_lag_delta(rows: DataFrame, values: list[str], part=PART, step: str = "step") -> DataFrame:
    ordered = Window.partitionBy(*part).orderBy(step)
    return rows.withColumns({f"delta_{v}": F.col(v) - F.lag(v).over(ordered) for v in values})


def evolution(states: DataFrame, values: list[str], parts: int = 8, part: str = "part_id") -> DataFrame:
    """Series of the first parts (a report over a fixed number of parts)."""
    first = states.select(part).distinct().orderBy(part).limit(parts)
    return states.join(F.broadcast(first), part, "left_semi").select(part, "step", *values)


def numbered_pairs(states: DataFrame, values: list[str], horizons: list[int], part=PART, step: str = "step", keep: list[str] | None = None) -> DataFrame:
    """(S_t, S_t+H) for each horizon, where `step` numbers the rows of a part without gaps or repeats.

    Rows meet by (part, step), so a part of any size is spread over all tasks, unlike `pairs`, whose
    window holds a part in one. `values` also come as next_<values>; `keep` only of S_t.
    """
    wanted = F.explode(F.array(*[F.lit(horizon_of(h)) for h in horizons])).alias("horizon")
    later = states.select(*part, F.col(step).alias("target_step"), *[F.col(v).alias(f"next_{v}") for v in values], wanted).withColumn(step, F.col("target_step") - F.col("horizon"))
    found = states.select(*part, step, *values, *(keep or [])).join(later.where(F.col(step) >= 0), [*part, step])
    return found.select(*part, step, *values, "target_step", *[f"next_{v}" for v in values], "horizon", *(keep or []))
