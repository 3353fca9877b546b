"""What a task or the driver holds does not grow with the tables; equal programs are run once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrail import preprocess
from kinetrail.kernel import extract
from kinetrail.operators import batching, graph, messages, validate
from kinetrail.plans import queries

SCHEMA = pa.schema([("status", pa.string()), ("value", pa.list_(pa.int32()))])


def counted(size=1_000_000, status="success"):
    ran = []
    return ran, extract.Remembered(SCHEMA, lambda code: ran.append(code) or (status, [1] * len(code or "")), size)


def test_equal_programs_run_once():
    ran, known = counted()
    for _ in range(3):
        assert [c.to_pylist() for c in known.rows(["a", "bb", "a", None])] == [["success"] * 4, [[1], [1, 1], [1], []]]
    assert ran == ["a", "bb", None]


def test_memory_of_programs_is_bounded():
    ran, known = counted(size=2_000)
    for i in range(200):
        known.rows(["x" * 50 + str(i)])
        assert known.bytes <= 2_000
    assert len(ran) == 200 and 0 < len(known.kept) < 20


@pytest.mark.parametrize("status", ["timeout", "runtime_error"])
def test_results_of_the_moment_are_not_remembered(status):
    ran, known = counted(status=status)
    known.rows(["a"]), known.rows(["a"])
    assert ran == ["a", "a"]


def test_tasks_grow_with_the_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(extract, "PARTS_A_TASK", 10)
    assert queries._plates(spark, sf).rdd.getNumPartitions() == queries._programs(spark, sf).rdd.getNumPartitions() == 20


def test_lineage_is_carried_through(spark):
    parts = spark.createDataFrame([("p", "train", "s1", 7, "r = cq.Workplane().box(1, 2, 3)"), ("q", "val", "s 2", 8, "((")], "part_id string, split string, source_shard string, source_row long, code string")
    results = extract.extract(parts, grid=2, samples=2, keep=preprocess.LINEAGE)
    carried, joined = preprocess.tables_of(results), preprocess.tables_of(extract.extract(parts, grid=2, samples=2), parts)
    for name, rows in carried.items():
        fixed = [c for c in rows.columns if c != "duration_s"]
        assert {*rows.columns} == {*joined[name].columns}
        assert sorted(map(str, rows.select(fixed).collect())) == sorted(map(str, joined[name].select(fixed).collect()))
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_is_spread_whatever_the_files(spark, tmp_path, monkeypatch):
    seen = []
    whole = extract.extract
    monkeypatch.setattr(extract, "extract", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or whole(rows, *a))
    rows = spark.createDataFrame([(str(i), b"r = cq.Workplane().box(1, 2, 3)", 2) for i in range(8)], "uuid string, cadquery_file binary, cadquery_ops_count int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/raw/data/train")
    preprocess.run(spark, f"{tmp_path}/raw", f"{tmp_path}/out", ["data=debug"])
    assert seen == [spark.sparkContext.defaultParallelism]


EDGES = [("a", 1, 2, 0, 0), ("a", 1, 2, 1, 1), ("a", 2, 1, 0, 2), ("a", 3, 1, 4, 3), ("a", 4, 4, 5, 4), ("a", None, 1, 6, 5), ("b", 2, 1, 0, 0), (None, 1, 2, 0, 0), (None, 2, 1, 0, 1)]


def test_simple_reverse_without_a_join(spark):
    adj = spark.createDataFrame(EDGES, "g string, src int, dst int, edge_idx int, adj_idx int")
    found = graph.with_reverse(adj, ["g"], simple=True)
    latest = {}
    for g, src, dst, _, i in EDGES:
        if None not in (g, src, dst):
            latest[g, src, dst] = max(i, latest.get((g, src, dst), -1))
    assert {(r.g, r.adj_idx, r.src): r.reverse_idx for r in found.collect()} == {(g, i, src): latest.get((g, dst, src), 0) for g, src, dst, _, i in EDGES}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_graphs_are_kept(spark):
    inc = spark.range(600).select((F.col("id") % 40).alias("g"), (F.col("id") % 7).alias("face_idx"), (F.col("id") % 90).alias("edge_idx"))
    plain, spread = graph.adjacency(inc, ["g"]), graph.adjacency(inc, ["g"], tasks=23)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
    assert spread.rdd.getNumPartitions() == 23
    assert spread._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1
    fused = messages.fuse(spread.withColumn("x", F.array("src")), "x", ["g"], tasks=17)
    assert fused.rdd.getNumPartitions() == 17


def test_collated_tables_are_not_broadcast(spark):
    states = spark.createDataFrame([("p", 0, 2, 1)], "part_id string, step int, num_faces int, num_edges int")
    faces = spark.createDataFrame([("p", 0, 0), ("p", 0, 1)], "part_id string, step int, face_idx int")
    inc = faces.withColumn("edge_idx", F.lit(0))
    batches = spark.createDataFrame([("p", 0, 0, 0)], "part_id string, step int, batch_id long, batch_pos int")
    tables = batching.collate(states, faces, inc.select("part_id", "step", "edge_idx").distinct(), graph.adjacency(inc), inc, batches)
    for name in ("faces", "face_adjacency", "face_edge"):
        assert tables[name].count() == 2
        assert "Broadcast" not in tables[name]._jdf.queryExecution().executedPlan().toString()


def test_encoder_runs_once_a_program(spark, sf, monkeypatch):
    sizes = []
    whole = extract.extract
    monkeypatch.setattr(extract, "extract", lambda rows, **k: sizes.append(rows.count()) or whole(rows, **k))
    programs = queries._programs(spark, sf)
    rows = queries.encoder_embeddings(spark, sf)
    assert sizes == [programs.select("code").distinct().count()] and sizes[0] < programs.count()
    assert rows.select("part_id").distinct().count() == programs.where((F.col("part_id").cast("int") % 5) < 3).count()


def test_parts_of_equal_programs_share_a_result(spark):
    codes = ["r = cq.Workplane().box(1, 2, 3)", "r = cq.Workplane().box(1, 2, 4)", "r = cq.Workplane().box(1, 2, 3)", "((", "((", None, "", *["result = cq.Workplane().box(1)"] * 3]
    parts = spark.createDataFrame([(str(i), c) for i, c in enumerate(codes)], "part_id string, code string")
    results, rows = extract.by_program(parts)
    key = {r.part_id: r.program for r in rows.collect()}
    statuses = {r.part_id: r.status for r in results.collect()}
    assert len(key) == len(codes) and {*key.values()} == {*statuses} and len(statuses) == results.count() == 2 + 1 + 1 + 3  # a failure of the moment is tried for every part
    each = extract.extract(parts).drop("duration_s")
    assert {r.part_id: r.status for r in each.collect()} == {p: statuses[k] for p, k in key.items()}
    shared = rows.select("part_id", "program").join(results.withColumnRenamed("part_id", "program"), "program").select(each.columns)
    assert sorted(map(str, shared.collect())) == sorted(map(str, each.collect()))


def test_rules_run_once_a_program(spark, tmp_path, monkeypatch):
    keys = [*range(40), 8, 8, None]
    spark.createDataFrame([(k, (k or 0) % 4) for k in keys] + [(40, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    rules, programs, faces = validate.states, queries._plate_programs, extract.faces
    monkeypatch.setattr(validate, "states", lambda states, *a, **k: seen.append(states.count()) or rules(states, *a, **k))
    found = lambda: sorted((str(r.part_id), r.violations) for r in queries.extracted_violations(spark, str(tmp_path)).collect())
    assert found() == sorted((str(k), 0) for k in [*keys, 40])  # repeated and missing keys too, as in SQL
    assert seen == [4 * 4]  # four programs with a start and three states
    # One face of the largest plate is lost, two parts have no split: every part has its program's violations and its own.
    monkeypatch.setattr(extract, "faces", lambda results: faces(results).where("NOT (step = 1 AND face_idx = 0 AND features[8] > 450)"))
    monkeypatch.setattr(queries, "_plate_programs", lambda *a: programs(*a).withColumn("split", F.when(~F.coalesce("part_id", F.lit("")).isin("5", "7"), F.col("split"))))
    assert found() == sorted((str(k), (k is not None and k % 4 == 3 and k < 40) + (k in (5, 7))) for k in [*keys, 40])
