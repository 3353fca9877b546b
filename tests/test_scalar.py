import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import scalar as S
from kinetrail.schema import ALIASES, COMMANDS, CURVE_GROUPS, EDGE_FEATURES, FACE_FEATURES, SURFACE_GROUPS


def one(spark, *columns, **values):
    row = spark.createDataFrame([values or {"_": 1}])
    return row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_symlog_goldens_and_round_trip(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 10.0, 50.0, 1000.0, -0.5, -25.0, 0.2]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.symlog("x").alias("y"), S.symexp(S.symlog("x")).alias("back")).collect()
    assert all(abs(r.back - r.x) < 1e-5 * max(1, abs(r.x)) for r in rows)
    y = {r.x: round(r.y, 3) for r in rows}
    assert (y[0.2], y[1000.0], y[-25.0]) == (0.182, 6.909, -3.258)


def test_symlog_property(spark):
    xs = np.random.default_rng(1).normal(0, 1e4, 500).tolist()
    back = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.symexp(S.symlog("x")).alias("b")).collect()
    assert max(abs(r.b - r.x) / max(1, abs(r.x)) for r in back) < 1e-9


@pytest.mark.parametrize(("bounds", "expected"), [("features", [0, 1, -1, 2]), ("params_raw", [0, 1e6, -1e6, 2]), ("params", [0, 20, -20, 2])])
def test_non_finite(spark, bounds, expected):
    v = F.array(*[F.lit(float(x)) for x in ("nan", "inf", "-inf", 2)])
    r = one(spark, S.nan_to_num_array(v, *S.BOUNDS[bounds]), S.all_finite(v), S.all_finite(F.array().cast("array<double>")))
    assert r.c0 == expected and not r.c1 and r.c2


def test_numbers(spark):
    args = F.array(*[F.lit(x) for x in ("15.5", "true", "-2.0", ">Z[1]", "5d", " 3 ", None, "inf", "1_000", "")])
    assert one(spark, S.numeric_args(args)).c0 == [15.5, -2.0, 3.0]
    kwargs = F.array(F.struct(F.lit("d").alias("k"), F.lit("7").alias("v")))
    assert one(spark, S.numeric_args(args, kwargs)).c0 == [15.5, -2.0, 3.0, 7.0]


def test_summary(spark):
    up, down, none = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0, 1), (0, 0, -1), ()))
    points = F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(100.0), F.lit(0.0), F.lit(0.0)))
    r = one(spark, S.action_summary(points, F.array(up, down), F.array(*[F.lit(float(i)) for i in range(1, 8)]))).c0
    assert r.params_raw == [50, 0, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6]
    assert r.params[0] == pytest.approx(math.tanh(0.5)) and r.params[6] == pytest.approx(math.log(2)) and r.param_mask == [True] * 12
    empty = F.array().cast("array<array<double>>")
    r = one(spark, S.action_summary(empty, empty, none.cast("array<double>"))).c0
    assert r.params == [0.0] * 12 and r.param_mask == [False] * 12
    r = one(spark, S.action_summary(empty, empty, none.cast("array<double>"), origin=up, z_dir=down)).c0
    assert r.params_raw[:6] == [0, 0, 1, 0, 0, -1] and r.param_mask == [True] * 6 + [False] * 6


def test_vocabulary(spark):
    names = ["Extrude ", "twistExtrude", "wedge", "unknown", "", None, "cutBlind"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(S.command_id("n").alias("i"), S.canonical_command("n").alias("c"), S.is_commit_op("n").alias("k")).collect()
    assert [r.i for r in rows] == [0, 0, 6, 15, 15, 15, 1]
    assert [r.c for r in rows] == ["EXTRUDE", "EXTRUDE", "BOX", None, None, None, "CUT"]
    assert [r.k for r in rows] == [True, True, True, False, False, False, True]
    assert set(ALIASES.values()) <= set(COMMANDS) and len(ALIASES) == 27 and len(COMMANDS) == 16
    assert len(FACE_FEATURES) == 32 and len(EDGE_FEATURES) == 16
    assert [one(spark, S.command_name(F.lit(i)), S.ref_kind_name(F.lit(i))).c0 for i in (0, 15, 99)] == ["EXTRUDE", "OTHER", "OTHER"]


def test_one_hot_and_assembly(spark):
    hot = lambda k, g, n: one(spark, S.one_hot(F.lit(k), g, n)).c0.index(1.0)
    assert [hot(k, SURFACE_GROUPS, 8) for k in ("Plane", "bezier", "extrusion", "offset", None)] == [0, 5, 6, 7, 7]
    assert [hot(k, CURVE_GROUPS, 6) for k in ("line", "hyperbola", "offset")] == [0, 3, 5]
    with pytest.raises(Exception, match="length 4"):
        one(spark, S.assemble(4, F.array(F.lit(1.0))))


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, S.normalize(v(3, 0, 4)), S.normalize(v(0, 0, 0)), S.flip(v(1, -2), F.lit(True)), S.pad(v(1, 2), 4), S.pad(v(1, 2, 3), 2), S.to_local(v(2, 3, 5), v(1, 1, 1), v(0, 1, 0), v(1, 0, 0)))
    assert r.c0 == pytest.approx([0.6, 0, 0.8]) and r.c1 == [0, 0, 1] and r.c2 == [-1, 2] and r.c3 == [1, 2, 0, 0] and r.c4 == [1, 2] and r.c5 == [2, 1]
    r = one(spark, S.linspace(F.lit(0.0), F.lit(1.0), 5), S.linspace(F.lit(0.0), F.lit(1.0), 4, False), S.transpose(v(1, 2, 3, 4, 5, 6), 2, 3), S.or_default(F.array(F.lit(True)), 2, False), S.masked(v(1, 2, 3), F.array(F.lit(True), F.lit(False), F.lit(True))))
    assert r.c0 == [0, 0.25, 0.5, 0.75, 1] and r.c1 == [0, 0.25, 0.5, 0.75] and r.c2 == [1, 4, 2, 5, 3, 6] and r.c3 == [False, False] and r.c4 == [1, 3]
    low, high = S.padded_box(F.lit(0.0), F.lit(10.0))
    r = one(spark, low, high, S.percent(F.lit(1), F.lit(0)), S.percent(F.lit(1), F.lit(4)), S.short_id(F.lit("abcdefghijk")), S.at_grid(v(1, 2, 3, 4), 1, 1, 2))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5) == (-0.5, 10.5, 0, 25, "abcdefgh", [3, 4])


def test_status_and_split(spark):
    rows = [None, "SyntaxError: x", "Unsupported operation: fillet", "ValueError", "Timeout after 15 s"]
    got = [r.s for r in spark.createDataFrame([(e,) for e in rows], "e string").select(S.error_status("e").alias("s")).collect()]
    assert got == ["success", "syntax_error", "unsupported_operation", "runtime_error", "timeout"]
    assert one(spark, S.split_alias(F.lit("validation")), S.split_alias(F.lit("test"))).c0 == "val"
    splits = spark.range(2000).select(S.split_of("id").alias("s")).groupBy("s").count().collect()
    assert 0.87 < {r.s: r["count"] for r in splits}["train"] / 2000 < 0.93


def test_resample_against_numpy(spark):
    from kinetrail.kernel.solids import resample

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (1.0, 5.0)]
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ring])
    got = one(spark, S.resample(points), S.resample(F.array(F.array(F.lit(1.0), F.lit(1.0)))))
    assert np.allclose(got.c0, resample(np.array(ring), 64)) and got.c1 is None
