"""What plans must and must not hold."""

import pytest

from kinetrail.operators import validate
from kinetrail.plans.queries import QUERIES
from kinetrail.storage import written

PYTHON = {"op_fold_step", "op_fold_stream", "container_scan", "program_ops_sql", "program_statuses", "program_states", "program_graphs", "encoder_embeddings", "program_actions", "program_steps", "face_values", "edge_values", "surface_grids", "extracted_violations", "violations_state", "routed_statuses", "program_ops", "transition_batches", "image_values", "preprocess_run"}
#: One row meets one row or a result.
ONE_ROW = {"multi_ref_stats", "collated_incidence"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_native_queries_stay_native(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not any(x in text for x in ("Python", "Pandas", "MapInArrow"))
    if name not in ONE_ROW:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "columns"), [("symlog_roundtrip", 2), ("md5_split", 1), ("surface_area_total", 2), ("message_pass_sum", 2)])
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    text = plan(QUERIES[name](spark, sf))
    schemas = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
    assert schemas and all(s.count(":") <= columns for s in schemas)


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["unsupported_counts"](spark, sf))
    assert "PushedFilters: [" in text


def test_adjacency_shuffles_by_edge_and_by_state_only(spark, sf):
    assert plan(QUERIES["reverse_edge_index"](spark, sf)).count("Exchange hashpartitioning") == 2


def test_validators_scan_each_table_once(spark):
    keys = "part_id string, step int, "
    columns = {
        "states": "num_faces int, num_edges int, num_solids int, volume double, surface_area double, bbox array<float>", "faces": "face_idx int, features array<float>, uv array<float>",
        "edges": "edge_idx int, features array<float>, u array<float>", "adjacency": "adj_idx int, src int, dst int, edge_idx int, reverse_idx int", "face_edge": "face_idx int, edge_idx int",
    }
    tables = {name: written(spark.createDataFrame([], keys + c), f"empty-{name}") for name, c in columns.items()}
    text = plan(validate.states(**tables))
    assert text.count("FileScan parquet") == 5 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text
