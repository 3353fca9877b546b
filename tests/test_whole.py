"""Queries that must take every row: values against brute force on small tables."""

import math
import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import kinetrail
from kinetrail import storage
from kinetrail.kernel import program, solids
from kinetrail.nn import layers as L
from kinetrail.nn.encoder import Encoder
from kinetrail.operators import graph, stats, transitions
from kinetrail.plans import queries
from kinetrail.sources import parts, shards
from kinetrail.streaming import oplog

# --- encoder ---------------------------------------------------------------

NORM = 1 / math.sqrt(1 + 1e-5)


def plain_forward(uv, u, edges, pointer, outputs, heads, rounds=3, seed=0):
    """The encoder by its definition, a face, an edge and a head at a time; edges: (src, dst, reverse)."""
    w = L.Weights(seed)
    lrelu, relu = (lambda x: np.where(x > 0, x, 0.01 * x)), (lambda x: np.where(x > 0, x, 0))
    taps = [[w.kaiming(b, a, *[3] * d) for a, b in ((channels, 64), (64, 128), (128, 256))] + [w.kaiming(pointer, 256)] for channels, d in ((6, 1), (7, 2))]
    fuse_edges, fuse_outputs = w.kaiming(pointer, pointer), w.kaiming(outputs, outputs)
    layers = []
    for _ in range(rounds - 1):
        node = [w.kaiming(pointer * pointer, pointer), w.kaiming(pointer, pointer), w.kaiming(pointer, pointer), w.kaiming(pointer, pointer)]
        layers.append((node, [w.kaiming(pointer, pointer) for _ in range(7)]))
    decode_edge, decode_node = ([w.kaiming(512, pointer), w.kaiming(256, 512), w.kaiming(outputs, 256)] for _ in range(2))

    def grid(x, kernels):
        *kernels, last = kernels
        for k in kernels:
            shape, out = x.shape[1:], np.zeros((len(k), *x.shape[1:]))
            for at in np.ndindex(shape):
                for tap in np.ndindex(k.shape[2:]):
                    here = tuple(a + t - 1 for a, t in zip(at, tap, strict=True))
                    if all(0 <= h < n for h, n in zip(here, shape, strict=True)):
                        out[(slice(None), *at)] += k[(slice(None), slice(None), *tap)] @ x[(slice(None), *here)]
            x = lrelu(out * NORM)
        return lrelu(last @ x.reshape(len(x), -1).mean(axis=1) * NORM)

    def fused(x, k):
        return [lrelu(k @ (a + x[back]) * NORM) for a, (_, _, back) in zip(x, edges, strict=True)]

    def decoded(x, k):
        return k[2] @ relu(k[1] @ relu(k[0] @ x * NORM) * NORM)

    nodes = faces = [grid(x, taps[1]) for x in uv]
    links = curves = fused([grid(x, taps[0]) for x in u], fuse_edges)
    for (message, residual, a, b), (project, m0, m1, q, k, v, o) in layers:
        got = [residual @ n for n in nodes]
        for (s, d, _), e in zip(edges, links, strict=True):
            got[d] = got[d] + nodes[s] @ (message @ e).reshape(pointer, pointer)
        nodes = [lrelu(b @ relu(a @ x * NORM) * NORM) for x in got]
        new, width = [], pointer // heads
        for (s, d, _), e in zip(edges, links, strict=True):
            mixed = []
            for h in range(heads):
                part = slice(h * width, (h + 1) * width)
                scores = np.array([(q @ e)[part] @ (k @ n)[part] / math.sqrt(width) for n in nodes])
                share = np.exp(scores - scores.max())
                mixed += list(sum(p * (v @ n)[part] for p, n in zip(share / share.sum(), nodes, strict=True)))
            seen = o @ np.array(mixed) + e
            seen = (seen - seen.mean()) / np.sqrt(seen.var() + 1e-5)
            new.append(lrelu(m1 @ relu(m0 @ (e + project @ nodes[s] + project @ nodes[d]) * NORM) * NORM + seen))
        links = fused(new, fuse_edges)
    ends = fused([decoded(e, decode_edge) for e in links], fuse_outputs)
    once = [i for i, (_, _, back) in enumerate(edges) if i < back]
    return {"node_pointer": faces, "node": [decoded(n, decode_node) for n in nodes], "edge_index": once, "edge_pointer": [curves[i] for i in once], "edge": [ends[i] for i in once]}


def test_encoder_values_against_definition():
    rng = np.random.default_rng(4)
    uv, u = rng.normal(size=(3, 7, 4, 4)), rng.normal(size=(6, 6, 4))
    edges = [(0, 1, 2), (0, 1, 3), (1, 0, 0), (1, 0, 1), (1, 2, 5), (2, 1, 4)]
    got = Encoder(pointer=16, outputs=8, heads=2, seed=3).forward(uv, u, *map(np.array, zip(*edges, strict=True)))
    want = plain_forward(uv, u, edges, 16, 8, 2, seed=3)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9), k


def test_encoder_query_takes_every_part_at_full_size(spark, tmp_path):
    spark.createDataFrame([(5, 3), (6, 4), (7, 5), (8, 6), (9, 7)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(x.part_id, x.kind, x.idx): x.total for x in queries.encoder_embeddings(spark, str(tmp_path)).collect()}
    want = {}
    for p, code in queries._programs(spark, str(tmp_path)).where("CAST(part_id AS INT) % 5 < 3").collect():
        solid = next(x[-1] for x in solids.build(program.operations(code)) if x[-1])
        as_stored = lambda x: x.astype(np.float32).astype(float)
        triples = sorted({(a, b, i) for i, e in enumerate(solid["edges"]) for a in e["faces"] for b in e["faces"] if a != b})
        edges = [(a, b, triples.index((b, a, i))) for a, b, i in triples]
        uv, u = [as_stored(f["patch"](16)) for f in solid["faces"]], [as_stored(solid["edges"][i]["curve"](16)) for _, _, i in triples]
        found = plain_forward(uv, u, edges, 128, 1024, 8)
        want |= {(p, "face", i): x.sum() for i, x in enumerate(found["node"])} | {(p, "edge", i): x.sum() for i, x in zip(found["edge_index"], found["edge"], strict=True)}
    assert got.keys() == want.keys() and len({p for p, _, _ in got}) == 3
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-8)


# --- messages --------------------------------------------------------------


def test_convolution_takes_every_edge(spark, tmp_path):
    pairs = [(e, f) for e in range(1, 15) for f in {e % 4, e * 3 % 5, 5}]
    spark.createDataFrame(pairs, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(f,) for f in range(7)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    want = {f: [0.5 * (f % 5) + 1, 2.0 * (f % 3) - 1] for f in range(7)}
    for e, a in pairs:
        for x, b in pairs:
            if e == x and a != b:
                want[b][0] += a % 5 * (e % 4) + a % 3
                want[b][1] += a % 5 + a % 3 * (e % 7)
    assert {x.face_idx: [x.o0, x.o1] for x in queries.QUERIES["nn_conv_sum"](spark, str(tmp_path)).collect()} == want


# --- lineage ---------------------------------------------------------------


def test_every_row_is_traced_back(spark, tmp_path):
    rows = [(i, "FOP"[i % 3]) for i in range(1, 121)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    found = queries.QUERIES["lineage_lookup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(k, k, s) for k, s in rows]


# --- ancestors -------------------------------------------------------------


def test_ancestors_at_any_distance(spark, tmp_path):
    rows = [(i, 1, i, "purchase" if i == 3 else "view") for i in range(2100)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    found = {x.node: (x.ancestor, x.depth) for x in queries.ancestor_reference(spark, str(tmp_path)).collect()}
    assert found == {i: (3, i - 3) if i >= 3 else (None, None) for i in range(2100)}


def test_ancestors_of_a_cycle_are_an_error(spark):
    nodes = spark.createDataFrame([(0, None, True), (1, 0, False), (2, 4, False), (3, 2, False), (4, 3, False)], "node long, parent long, hit boolean")
    with pytest.raises(ValueError, match="cycle"):
        graph.nearest_ancestor(nodes, F.col("hit"))
    chain = spark.createDataFrame([(i, i - 1, False) for i in range(4)], "node long, parent long, hit boolean")  # the last parent is no node
    assert [x.ancestor for x in graph.nearest_ancestor(chain, F.col("hit")).collect()] == [None] * 4


# --- reverse edges ---------------------------------------------------------

JOINED = f"""
WITH {queries.ADJACENCY} SELECT a.g, a.adj_idx::BIGINT AS adj_idx, a.src, a.dst, coalesce(b.adj_idx, a.adj_idx)::BIGINT AS reverse_idx, (a.src + 2 * a.dst + b.src + 2 * b.dst)::DOUBLE AS fused
FROM adj a LEFT JOIN adj b ON a.g = b.g AND a.src = b.dst AND a.dst = b.src AND a.edge_idx = b.edge_idx
"""


def test_ranks_are_the_reverse_edges(spark, sf, duck, same_rows):
    """The registered SQL ranks reverse edges; here they are found by a join."""
    joined = duck.sql(JOINED).df()
    found = {n: queries.QUERIES[n](spark, sf).toPandas() for n in ("reverse_edge_index", "undirected_edges", "fuse_reverse")}
    same_rows(found["reverse_edge_index"], joined[["g", "adj_idx", "reverse_idx"]])
    same_rows(found["undirected_edges"], joined[joined.adj_idx < joined.reverse_idx][["g", "adj_idx", "src", "dst"]])
    same_rows(found["fuse_reverse"], joined[["g", "adj_idx", "fused"]])


# --- durations -------------------------------------------------------------


def test_durations_of_any_groups(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(size=101)] + [("b", 3.0), ("c", None), (None, 1.0), (None, 2.0), ("d", None), ("d", 7.0)] + [("e", float(x)) for x in rng.integers(0, 3, 40)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {x.k: (x.n, x.mean, x.median, x.p95) for x in stats.duration_stats(df, "x", ["k"]).collect()}
    for key in {k for k, _ in rows}:
        values = [x for k, x in rows if k == key and x is not None]
        want = (len(values), np.mean(values), np.median(values), np.quantile(values, 0.95)) if values else (0, 0, 0, 0)
        assert got[key] == pytest.approx(want), key
    assert len(got) == 6
    whole = stats.duration_stats(df, "x").first()
    assert (whole.n, whole.median) == (sum(x is not None for _, x in rows), pytest.approx(np.median([x for _, x in rows if x is not None])))
    assert tuple(stats.duration_stats(df.limit(0), "x").first()) == (0, 0.0, 0.0, 0.0)


# --- streams ---------------------------------------------------------------


def _streamed(spark, tmp_path, batches, name, **options):
    """Each batch is a file of its own, taken one a micro batch."""
    source = tmp_path / f"{name}-in"
    schema = "part_id string, seq long, op_name string, measure double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        os.utime(max(source.glob("*.parquet"), key=lambda f: f.stat().st_ctime_ns), (1_600_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = oplog.fold_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-at"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{name}-out")).collect()))


def test_fold_over_micro_batches_out_of_order(spark, tmp_path):
    rows = [(p, i, "box" if i % 3 else "faces", float(i)) for p in ("a", "b") for i in range(1, 10)]
    order = [rows[k::4] for k in (2, 0, 3, 1)]
    ops = spark.createDataFrame(rows, "part_id string, seq long, op_name string, measure double")
    want = sorted(map(tuple, oplog.fold_native(ops).collect()))
    assert _streamed(spark, tmp_path, order, "gapless", start=1) == want
    assert sorted(map(tuple, oplog.fold(ops).collect())) == want == sorted(map(tuple, oplog.fold(ops, lambda s, r: oplog.advance(s, r)).collect()))
    assert _streamed(spark, tmp_path, [[r for r in rows if r[1] < 5], [r for r in rows if r[1] > 5]], "gaps") != []
    with pytest.raises(StreamingQueryException, match="after its successors"):
        _streamed(spark, tmp_path, [[r for r in rows if r[1] > 4], [r for r in rows if r[1] < 5]], "late")


# --- geometry --------------------------------------------------------------


def _sampled_moments(solid, n=400):
    """Area, centroid and moments of each face from its grid samples."""
    for f in solid["faces"]:
        grid = f["patch"](n)
        p, mask = grid[:3], grid[6]
        if f["kind"] == "sphere":
            weight = np.cos(np.linspace(-np.pi / 2, np.pi / 2, n))[None, :] * mask
        else:
            weight = mask.copy()
        for axis in (0, 1):  # trapezoids
            edge = [slice(None)] * 2
            for k in (0, -1):
                edge[axis] = k
                weight[tuple(edge)] *= 0.5
        c = (p * weight).sum(axis=(1, 2)) / weight.sum()
        second = (((p - c[:, None, None]) ** 2) * weight).sum(axis=(1, 2)) / weight.sum() * f["area"]
        yield f, c, (second[1] + second[2], second[0] + second[2], second[0] + second[1])


@pytest.mark.parametrize("code", ["box(3, 4, 5)", "cylinder(6, 2)", "sphere(2)", "polyline([(0, 0), (5, 0), (4, 3), (1, 2)]).close().extrude(2)", "rect(8, 6).circle(1.5).extrude(3)", "box(20, 20, 5).faces('>Z').workplane().hole(4).faces('>Z').workplane().center(7, 0).circle(1.5).cutThruAll()"])
def test_faces_agree_with_their_grids(code):
    solid = [x[-1] for x in solids.build(program.operations(f"r = cq.Workplane('XY').{code}")) if x[-1]][-1]
    for f, centroid, inertia in _sampled_moments(solid):
        assert np.allclose(centroid, f["centroid"], atol=0.05), f["kind"]
        assert np.allclose(inertia, f["inertia"], rtol=0.03, atol=0.05), f["kind"]
        middle = f["patch"](9)[:, 4, 4]
        if middle[6]:
            assert np.allclose(middle[3:6], f["normal"], atol=1e-6)
    flux = 0.0
    for f, centroid, _ in _sampled_moments(solid):  # the divergence theorem: outward normals and volume
        grid = f["patch"](400)
        weight = np.cos(np.linspace(-np.pi / 2, np.pi / 2, 400))[None, :] * grid[6] if f["kind"] == "sphere" else grid[6]
        flux += ((grid[:3] * grid[3:6]).sum(axis=0) * weight).sum() / weight.sum() * f["area"]
    assert flux / 3 == pytest.approx(solid["volume"], rel=0.01)
    for e in solid["edges"]:
        points = e["curve"](401)
        assert np.hypot.reduce(np.diff(points[:3], axis=1), axis=0).sum() == pytest.approx(e["length"], rel=1e-3)
        assert np.allclose(points[:, 200], e["midpoint"] + e["tangent"], atol=1e-6)


def test_references_of_actions():
    def actions(code):
        return [(x[3]["ref_kind"], x[3]["ref_entity_indices"], x[3]["ref_points"]) for x in solids.build(program.operations(code)) if x[-1]]

    start = "r = cq.Workplane().box(10, 10, 4)"
    assert actions(start) == [(1, [0], [[0.0, 0.0, 0.0]])]
    assert actions(f"{start}.faces('>Z').workplane().hole(2)")[1] == (2, [1], [[0.0, 0.0, 2.0]])
    kind, hosts, points = actions(f"{start}.edges('|Z').hole(2)")[1]
    assert kind == 3 and len(hosts) == 4 and all(abs(x) == abs(y) == 5 for x, y, _ in points)
    kind, hosts, points = actions(f"{start}.vertices('>Z').hole(2)")[1]
    assert kind == 4 and hosts == [0] * 4 and {p[2] for p in points} == {2.0}
    for bad in ("edges('|Z').fillet(1)", "hole(20)", "faces('>X').workplane().hole(1)", "faces('>Z[1]').hole(1)", "hole(2).hole(2)", "box(1, 1, 1)"):
        with pytest.raises(program.Unsupported):
            solids.build(program.operations(f"{start}.{bad}"))
    with pytest.raises(program.Unsupported):
        solids.build(program.operations("r = cq.Workplane('XZ').box(1, 2, 3)"))


def test_profiles_of_actions():
    found = [x[3]["profile"] for x in solids.build(program.operations("r = cq.Workplane().rect(8, 6).circle(1.5).extrude(3)")) if x[-1]][0]
    assert (found["num_wires"], found["num_outer_loops"], found["num_inner_loops"]) == (2, 1, 1) and found["total_wire_length"] == pytest.approx(28 + 3 * np.pi)
    assert len(found["points_2d"]) == 64 and [w["is_inner_loop"] for w in found["wires"]] == [False, True]
    assert [p["type"] for p in found["primitives"]] == ["LINE"] * 4 + ["CIRCLE"] and found["wires"][1]["bbox"] == [-1.5, -1.5, 0.0, 1.5, 1.5, 0.0]


def test_first_chain_is_the_result():
    ops, calls = program.parse("a = cq.Workplane().box(1, 2, 3)\nb = cq.Workplane().sphere(2)\nc = a.faces('>Z')")
    assert [n for n, _, _ in ops] == ["Workplane", "box"] and [n for n, _, _ in calls] == ["Workplane", "box", "Workplane", "sphere", "faces"]
    assert [n for n, _, _ in program.operations("a = cq.Workplane().box(1, 2, 3)\npart = cq.Workplane().sphere(2)")] == ["Workplane", "sphere"]


# --- offline extraction ----------------------------------------------------


def test_preprocessing_is_incremental(spark, sf, tmp_path):
    root, out = queries._raw_parts(spark, sf), str(tmp_path / "out")
    rows = lambda df: df.select("split", "source_shard", "attempted", "succeeded", "bytes", "created_at", "shapes", "vocabulary").collect()
    first = rows(kinetrail.run(spark, root, out, ["data=debug", "preprocess.split=val"]))
    assert {r.split for r in first} == {"val"} and all(r.bytes > 0 and r.shapes["uv"] == [7, 4, 4] and "EXTRUDE" in r.vocabulary for r in first)
    both = rows(kinetrail.run(spark, root, out, ["data=debug", "preprocess.split=all"]))
    assert {r.split for r in both} == {"train", "val"} and {r.source_shard: r for r in both if r.split == "val"} == {r.source_shard: r for r in first}
    states = shards.read(spark, out, "states", "validation")
    assert states.where("step = 0").count() == sum(r.succeeded for r in first)
    nested = transitions.trajectories(states.drop("split", "source_shard"), shards.read(spark, out, "actions").drop("split", "source_shard"))
    part = nested.select("part_id").first().part_id
    shards.write_trajectory(nested, part, str(tmp_path / "one"))
    assert [r.part_id for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [part]
    some = parts.first_parts(parts.scan(spark, root), 7).collect()
    assert len(some) == 7 and {r.split for r in some} == {"train"}


def test_corrupt_shards_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "states"))
    (tmp_path / "states" / "bad.parquet").write_bytes(b"no parquet at all")
    rows = shards.read(spark, str(tmp_path), "states", skip_corrupt=True, cached=True)
    assert rows.count() == 3 and rows.storageLevel.useMemory and rows.storageLevel.useDisk
    rows.unpersist()


def test_work_tables_of_a_scope_are_deleted(spark):
    with storage.scope(spark):
        path = storage.written(spark.range(3), "scoped").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))
