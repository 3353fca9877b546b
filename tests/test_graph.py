import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.kernel import extract, program, solids
from kinetrail.nn import layers as L
from kinetrail.nn.encoder import Encoder, normalize_images, to_planes
from kinetrail.operators import batching, graph, messages, stats, transitions, validate
from kinetrail.schema import blank_images, empty_states

KEYS = ["part_id", "step"]


def incidence(spark, pairs):
    return spark.createDataFrame([("p", 1, f, e) for f, e in pairs], "part_id string, step int, face_idx int, edge_idx int")


def extracted(spark, *codes):
    return extract.extract(spark.createDataFrame([(str(i), c) for i, c in enumerate(codes)], "part_id string, code string")).persist()


@pytest.mark.parametrize(
    ("pairs", "directed"),
    [([(0, 0), (0, 0)], 0), ([(0, 0)], 0), ([(0, 0), (1, 0), (2, 0)], 6), ([(0, 0), (1, 0), (0, 1), (1, 1)], 4)],
    ids=["seam", "laminar", "non_manifold", "parallel"],
)
def test_adjacency_cases(spark, pairs, directed):
    rows = graph.adjacency(incidence(spark, pairs)).collect()
    assert len(rows) == directed
    at = {r.adj_idx: r for r in rows}
    assert sorted(at) == list(range(directed))
    for r in rows:
        back = at[r.reverse_idx]
        assert (back.src, back.dst, back.edge_idx) == (r.dst, r.src, r.edge_idx) and back.reverse_idx == r.adj_idx


def test_adjacency_against_loops(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(f), int(e)) for f, e in zip(rng.integers(0, 8, 60), rng.integers(0, 20, 60), strict=True)})
    expected = sorted((a, b, e) for a, e in pairs for b, x in pairs if e == x and a != b)
    rows = graph.adjacency(incidence(spark, pairs)).orderBy("adj_idx").collect()
    assert [(r.src, r.dst, r.edge_idx) for r in rows] == expected and len(rows) % 2 == 0
    assert graph.undirected(graph.adjacency(incidence(spark, pairs))).count() * 2 == len(expected)


def test_box_from_program(spark):
    results = extracted(spark, "import cadquery as cq\nresult = cq.Workplane('XY').box(10, 20, 30)")
    state = extract.states(results).first()
    assert (state.num_faces, state.num_edges, state.num_solids, round(state.volume, 6)) == (6, 12, 1, 6000.0)
    inc = extract.face_edge(results)
    adj = graph.adjacency(inc)
    assert inc.count() == 24 and adj.count() == 24
    assert {r.features[15] for r in extract.edges(results).collect()} == {1.0}
    faces = extract.faces(results).collect()
    assert sorted(r.features[8] for r in faces) == [200, 200, 300, 300, 600, 600] and all(len(r.features) == 32 for r in faces)


def test_program_faults(spark):
    codes = ["result = ((", "cq.Workplane().box(1, 1, 1).fillet(0.1)", "import os\nos.system('x')", "r = cq.Workplane().circle(2).extrude(3)", "result = cq.Workplane().box(1)", None, "while True:\n    pass"]
    rows = {r.part_id: r for r in extract.statuses(extracted(spark, *codes)).collect()}
    assert [rows[str(i)].status for i in range(7)] == ["syntax_error", "unsupported_operation", "unsupported_operation", "success", "runtime_error", "unsupported_operation", "unsupported_operation"]
    assert stats.run_summary(extract.statuses(extracted(spark, *codes)), F.lit(1)).first().succeeded == 1


def test_kernel_measures():
    assert solids.sphere(2)["volume"] == pytest.approx(4 / 3 * np.pi * 8)
    tri = solids.prism(np.array([(0, 0), (0, 3), (4, 0)]), 0, 5)
    assert tri["volume"] == pytest.approx(30) and len(tri["faces"]) == 5 and len(tri["edges"]) == 9
    ring = solids.resample(np.array([(0.0, 0.0), (1, 0), (1, 1), (0, 1)]), 64)
    assert len(ring) == 64 and np.allclose(np.hypot(*np.diff(ring, axis=0).T), 1 / 16)
    ops = program.operations("h = 2\npart = w.Workplane().box(-1, h * 3, [1, 2])\nx = part.faces('>Z')")
    assert ops[1] == ("box", [-1, 6, [1, 2]], []) and len(ops) == 2


def test_mesh_volume(spark):
    p = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    tris = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    rows = [("t", *[[float(x) for x in p[i]] for i in t]) for t in tris]
    df = spark.createDataFrame(rows, "part_id string, a array<double>, b array<double>, c array<double>")
    assert stats.mesh_volume(df, ["part_id"]).first().volume == pytest.approx(1 / 6)


@pytest.mark.parametrize("horizon", [1, 2, 3])
def test_horizon(spark, horizon):
    lengths = [0, 1, 2, 5]
    rows = [(str(k), s) for k in lengths for s in range(k + 1)]
    found = transitions.transition_index(spark.createDataFrame(rows, "part_id string, step int"), horizon)
    assert found.count() == sum(max(0, k - horizon + 1) for k in lengths)
    assert transitions.transition_index(spark.createDataFrame(rows, "part_id string, step int"), horizon, max_samples=2).count() == 2


def test_ragged_batch(spark):
    rows = [(f"p{i}", 0, n, n, i) for i, n in enumerate((0, 3, 1))]
    graphs = spark.createDataFrame(rows, "part_id string, step int, num_faces int, num_edges int, k int")
    batch = batching.assign_batches(graphs, 8, ["k"]).select("part_id", "step", "batch_id", "batch_pos")
    faces = spark.createDataFrame([(f"p{i}", 0, f) for i, n in enumerate((0, 3, 1)) for f in range(n)], "part_id string, step int, face_idx int")
    adj = spark.createDataFrame([("p1", 0, 0, 0, 1, 0, 0)], "part_id string, step int, adj_idx int, src int, dst int, edge_idx int, reverse_idx int")
    inc = spark.createDataFrame([("p2", 0, 0, 0)], "part_id string, step int, face_idx int, edge_idx int")
    tables = batching.collate(graphs.drop("k"), faces, faces.withColumnRenamed("face_idx", "edge_idx"), adj, inc, batch)
    assert [r.face_offset for r in tables["graphs"].orderBy("batch_pos").collect()] == [0, 0, 3]
    assert sorted(r.face_idx for r in tables["faces"].collect()) == [0, 1, 2, 3]
    assert tables["face_edge"].first().face_idx == 3
    assert validate.batch(tables).count() == 0
    assert sorted((r.batch_pos, r.node) for r in batching.batch_vector(tables["graphs"], "num_faces").collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_global_rank_matches_sort(spark):
    ids = spark.range(1000).select(F.xxhash64("id").alias("k"))
    ranked = batching.global_rank(ids, ["k"], "rank").orderBy("k").collect()
    assert [r.rank for r in ranked] == list(range(1000))


def test_references_and_ancestors(spark):
    faces = spark.createDataFrame([("p", 1, 0, "a"), ("p", 1, 1, "b"), ("p", 1, 2, "a")], "part_id string, step int, face_idx int, face_key string")
    picked = spark.createDataFrame([("p", 1, "a"), ("p", 1, "z")], "part_id string, step int, face_key string")
    rows = {r.face_key: r for r in graph.match_faces(picked, faces).collect()}
    assert (rows["a"].ref_entity_idx, rows["a"].matched, rows["z"].ref_entity_idx, rows["z"].matched) == (0, True, 0, False)
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i in (0, 3)) for i in range(40)], "node int, parent int, hit boolean")
    found = {r.node: (r.ancestor, r.depth) for r in graph.nearest_ancestor(nodes, F.col("hit")).collect()}
    assert found[0] == (0, 0) and found[2] == (0, 2) and found[3] == (3, 0) and found[39] == (3, 36)


def test_fuse_and_conv_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, e = 5, 9
    src, dst, h, w = rng.integers(0, n, e), rng.integers(0, n, e), rng.normal(size=(n, 2)), rng.normal(size=(e, 2, 3))
    nodes = spark.createDataFrame([("p", 0, i, h[i].tolist()) for i in range(n)], "part_id string, step int, face_idx int, h array<double>")
    edges = spark.createDataFrame([("p", 0, int(a), int(b), w[i].reshape(-1).tolist()) for i, (a, b) in enumerate(zip(src, dst, strict=True))], "part_id string, step int, src int, dst int, w array<double>")
    for how in ("sum", "mean"):
        expected = np.zeros((n, 3))
        np.add.at(expected, dst, np.einsum("ei,eio->eo", h[src], w))
        if how == "mean":
            expected /= np.maximum(np.bincount(dst, minlength=n), 1)[:, None]
        got = messages.nn_conv(nodes, edges, F.col("w"), 2, 3, how).orderBy("face_idx").collect()
        assert np.allclose([r.h for r in got], expected)
    with pytest.raises(NotImplementedError):
        messages.nn_conv(nodes, edges, F.col("w"), 2, 3, "max")


def test_encoder_shapes_and_isolation():
    model = Encoder(pointer=16, outputs=8, heads=2, seed=3)
    rng = np.random.default_rng(0)
    uv, u = rng.normal(size=(3, 7, 4, 4)), rng.normal(size=(4, 6, 4))
    src, dst, reverse = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([1, 0, 3, 2])
    a = model.forward(uv, u, src, dst, reverse)
    assert a["node"].shape == (3, 8) and a["edge"].shape == (2, 8) and a["edge_index"].tolist() == [0, 2] and np.isfinite(a["node"]).all()
    b = Encoder(pointer=16, outputs=8, heads=2, seed=3).forward(uv, u, src, dst, reverse)
    assert np.array_equal(a["node"], b["node"])
    alone = model.forward(uv[:1], u[:0], src[:0], dst[:0], reverse[:0])
    assert alone["node"].shape == (1, 8) and alone["edge"].shape == (0, 8)
    x = rng.normal(size=(2, 3, 5))
    w = L.Weights(1)
    conv, kernel = w.conv(3, 4, 1), L.Weights(1).kaiming(4, 3, 3)
    pad = np.pad(x, [(0, 0), (0, 0), (1, 1)])
    plain = np.array([[[sum((pad[i, :, t : t + 3] * kernel[o]).sum() for _ in (0,)) for t in range(5)] for o in range(4)] for i in range(2)])
    assert np.allclose(conv(x), L.leaky(plain / np.sqrt(1 + 1e-5)))


def test_images(spark):
    pixels = bytes(range(4 * 4))
    df = spark.createDataFrame([(bytearray(pixels),), (bytearray(b"x"),)], "pixels binary")
    rows = to_planes(df, 2).collect()
    assert bytes(rows[0].pixels) == bytes([0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14]) and bytes(rows[1].pixels) == bytes([220] * 12)
    values = normalize_images(to_planes(df, 2)).collect()[0]["values"]
    assert values[1] == pytest.approx(4 / 255)


def test_empty_start(spark):
    parts = spark.createDataFrame([("a",), ("b",)], "part_id string")
    states, images = empty_states(parts), blank_images(parts, 2)
    assert validate.empty_start(states).count() == 0 and validate.blank_start(images).count() == 0 and images.count() == 8
    assert validate.empty_start(states.withColumn("volume", F.lit(2.0))).select("rule").distinct().first().rule == "s0.volume"
    assert validate.blank_start(images.withColumn("pixels", F.unhex(F.lit("DCDD")))).count() == 8


def test_state_violations(spark):
    results = extracted(spark, "result = cq.Workplane().box(1, 2, 3)")
    inc = extract.face_edge(results)
    adj, states = graph.adjacency(inc), extract.states(results)
    fill = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    faces, edges = extract.faces(results).withColumn("uv", fill(7 * 4)), extract.edges(results).withColumn("u", fill(12))
    rules = lambda **t: sorted({r.rule for r in validate.states(**({"states": states, "faces": faces, "edges": edges, "adjacency": adj, "face_edge": inc} | t), grid=2, samples=2).collect()})
    assert rules() == []
    assert rules(faces=faces.where("face_idx > 0")) == ["faces.count"]
    assert rules(faces=faces.withColumn("uv", F.array_repeat(F.lit(0.5).cast("float"), 28))) == ["uv_mask.binary"]
    assert rules(faces=faces.withColumn("features", F.transform("features", lambda x: x * float("nan")))) == ["faces.features.finite"]
    assert rules(faces=faces.withColumn("features", F.slice("features", 1, 31))) == ["faces.features.shape"]
    assert rules(edges=edges.withColumn("u", F.slice("u", 1, 3))) == ["edges.u.shape"]
    assert rules(adjacency=adj.withColumn("src", F.col("src") + 5)) == ["adjacency.src"]
    assert rules(adjacency=adj.withColumn("dst", F.lit(-1))) == ["adjacency.dst"]
    assert rules(adjacency=adj.withColumn("reverse_idx", F.lit(None).cast("int"))) == ["adjacency.reverse"]
    assert rules(adjacency=adj.withColumn("reverse_idx", F.lit(24))) == ["adjacency.reverse"]
    assert rules(adjacency=adj.withColumn("edge_idx", F.lit(40))) == ["adjacency.edge", "adjacency.features"]
    assert rules(edges=edges.withColumn("features", F.slice("features", 1, 15))) == ["adjacency.features.shape", "edges.features.shape"]
    assert rules(edges=edges.withColumn("features", F.transform("features", lambda x: x * float("nan")))) == ["adjacency.features.finite", "edges.features.finite"]
    assert rules(face_edge=inc.withColumn("face_idx", F.lit(99))) == ["incidence.face"]
    assert rules(states=states.withColumn("volume", F.lit(None).cast("double"))) == ["state.required.volume"]


def test_action_and_trajectory_violations(spark):
    good = spark.createDataFrame([("p", 0)], "part_id string, step int").select(
        "part_id", "step", F.lit("box").alias("operation_name"), F.lit(6).alias("cmd_id"), *[F.array_repeat(F.lit(0.0), 12).alias(c) for c in ("params_raw", "params")], F.array_repeat(F.lit(True), 12).alias("param_mask"),
        F.lit(0).alias("ref_kind"), F.array(F.lit(1)).alias("ref_entity_indices"), *[F.array(F.array_repeat(F.lit(0.0), 3)).alias(c) for c in ("ref_points", "ref_directions")],
    )
    rules = lambda df: sorted(r.rule for r in validate.actions(df).collect())
    assert rules(good) == []
    assert rules(good.withColumn("cmd_id", F.lit(16))) == ["action.cmd_id"]
    assert rules(good.withColumn("params", F.array_repeat(F.lit(0.0), 11))) == ["action.params.shape"]
    assert rules(good.withColumn("params", F.array_repeat(F.lit(float("inf")), 12))) == ["action.params.finite"]
    assert rules(good.withColumn("ref_points", F.array(F.array(F.lit(0.0))))) == ["action.references"]
    assert "action.required.cmd_id" in rules(good.withColumn("cmd_id", F.lit(None).cast("int")))
    t = spark.createDataFrame([("p", "train", "s", 0, 1)], "part_id string, source_split string, source_shard string, source_row int, num_steps int")
    states = spark.createDataFrame([("p", 0), ("p", 1)], "part_id string, step int")
    assert validate.trajectories(t, states, good).count() == 0
    assert [r.rule for r in validate.trajectories(t, states.limit(1), good).collect()] == ["trajectory.causal"]
    meta = spark.createDataFrame([("s", "0.2.0")], "source_shard string, schema_version string")
    assert validate.shards(meta).count() == 1
