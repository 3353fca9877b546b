"""Scalar operators as Column -> Column: normalizers, vectors, one-hot, vocabulary, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALIASES, COMMANDS, COMMIT_OPS, METRIC_ARGS, OTHER, PARAMS, REF_KINDS

INF = float("inf")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- normalizers -----------------------------------------------------------


def symlog(x) -> Column:
    x = _col(x).cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x) -> Column:
    x = _col(x).cast("double")
    return F.signum(x) * F.expm1(F.abs(x))


def squash(x, scale: float = 100.0) -> Column:
    """Positions into (-1, 1)."""
    return F.tanh(_col(x).cast("double") / scale)


def is_finite(x) -> Column:
    x = _col(x)
    return ~F.isnan(x) & (F.abs(x) < INF)


def all_finite(a) -> Column:
    """True for empty arrays."""
    return F.forall(_col(a), is_finite)


def nan_to_num(x, nan: float = 0.0, pos: float = 1.0, neg: float = -1.0) -> Column:
    x = _col(x)
    return F.when(F.isnan(x), F.lit(nan)).when(x == INF, F.lit(pos)).when(x == -INF, F.lit(neg)).otherwise(x)


def nan_to_num_array(a, nan: float = 0.0, pos: float = 1.0, neg: float = -1.0) -> Column:
    return F.transform(_col(a), lambda x: nan_to_num(x.cast("double"), nan, pos, neg))


#: Bounds by kind of vector: (nan, +inf, -inf).
BOUNDS = {"features": (0.0, 1.0, -1.0), "params_raw": (0.0, 1e6, -1e6), "params": (0.0, 20.0, -20.0)}


# --- vectors ---------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v, fallback=(0.0, 0.0, 1.0), eps: float = 1e-6) -> Column:
    """Unit vector; the fallback where the norm is eps or less."""
    other = F.array(*[F.lit(x) for x in fallback])
    return let(_col(v), lambda w: let(norm(w), lambda n: F.when(n > eps, F.transform(w, lambda x: F.try_divide(x.cast("double"), n))).otherwise(other)))


def flip(v, reversed_) -> Column:
    v = _col(v)
    return F.when(_col(reversed_), F.transform(v, lambda x: -x)).otherwise(v)


def subtract(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def centroid(points) -> Column:
    """Mean vector of an array of 3-vectors; null if there are none."""
    points = _col(points)
    n = F.size(points)
    at = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(i)).cast("double"))
    return F.when(n > 0, F.array(*[F.try_divide(at(i), n) for i in range(3)]))


def to_local(point, origin, x_axis, y_axis) -> Column:
    """World to the plane's 2-D frame."""
    d = subtract(point, origin)
    return F.array(dot(d, x_axis), dot(d, y_axis))


def linspace(a, b, n: int, endpoint: bool = True) -> Column:
    a, b = _col(a).cast("double"), _col(b).cast("double")
    steps = n - 1 if endpoint else n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + i * (b - a) / float(max(steps, 1))) if n > 0 else F.array().cast("array<double>")


def pad(a, n: int, fill=0.0) -> Column:
    """First n entries, filled up at the end."""
    a = _col(a)
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), n)), 1, n)


def or_default(a, n, fill) -> Column:
    """`a` if it has n entries, else n times the fill."""
    a = _col(a)
    n = _col(n) if not isinstance(n, int) else F.lit(n)
    return F.when(F.size(a) == n, a).otherwise(F.array_repeat(F.lit(fill), n.cast("int")))


def resample(points, n: int = 64) -> Column:
    """n points at equal arc lengths along a closed polygon of 2-vectors, end excluded; null if it has no length."""
    step = lambda v, k: F.get(v, (k + 1) % F.size(v)) - F.get(v, k)
    axis = lambda ps, i: F.transform(ps, lambda p: F.get(p, F.lit(i)).cast("double"))
    lengths = lambda c: F.transform(F.sequence(F.lit(0), F.size(c["x"]) - 1), lambda k: F.hypot(step(c["x"], k), step(c["y"], k)))
    cumulated = lambda each: F.aggregate(each, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))

    def at(c: Column, each: Column, ends: Column, t: Column) -> Column:
        def between(k: Column) -> Column:
            share = F.coalesce(F.try_divide(t - F.get(ends, k), F.get(each, k)), F.lit(0.0))
            return let(share, lambda s: F.array(*[F.get(c[i], k) + s * step(c[i], k) for i in ("x", "y")]))

        return let(F.size(F.filter(ends, lambda e: e <= t)) - 1, between)

    def spread(c: Column, each: Column, ends: Column) -> Column:
        total = F.element_at(ends, -1)
        return F.when(total > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: let(i.cast("double") / n * total, lambda t: at(c, each, ends, t))))

    bound = lambda ps: F.struct(axis(ps, 0).alias("x"), axis(ps, 1).alias("y"))
    found = let(_col(points), lambda ps: let(bound(ps), lambda c: let(lengths(c), lambda each: let(cumulated(each), lambda ends: spread(c, each, ends)))))
    return F.when(F.size(_col(points)) > 0, found)


def masked(a, mask) -> Column:
    return F.transform(F.filter(F.arrays_zip(_col(a).alias("x"), _col(mask).alias("m")), lambda z: z["m"]), lambda z: z["x"])


def at_grid(a, channel: int, rows: int, cols: int) -> Column:
    """One channel of a flat [channels, rows, cols] array."""
    return F.slice(_col(a), channel * rows * cols + 1, rows * cols)


def transpose(a, rows: int, cols: int) -> Column:
    """A flat [rows, cols] array as [cols, rows]."""
    a = _col(a)
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.get(a, (k % rows) * cols + F.floor(k / rows).cast("int")))


# --- geometry descriptors --------------------------------------------------


def log_area(area) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), _col(area).cast("double")))


def aspect(a, b, eps: float = 1e-5) -> Column:
    return _col(a) / (_col(b) + eps)


def diagonal(dx, dy, dz) -> Column:
    return F.sqrt(_col(dx) * _col(dx) + _col(dy) * _col(dy) + _col(dz) * _col(dz))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def one_hot(kind, groups: dict[str, int], size: int) -> Column:
    """Categories by name in groups; unknown and null names are the last."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    at = F.coalesce(F.try_element_at(table, F.lower(F.trim(_col(kind)))), F.lit(size - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: flag(i == at))


def assemble(size: int, *parts: Column) -> Column:
    """Concatenated feature vector; any other length is an error."""
    vector = F.concat(*[p if isinstance(p, Column) else F.array(*p) for p in parts])
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(F.lit(f"feature vector is not of length {size}")).cast("array<double>"))


def padded_box(low, high, share: float = 0.05, least: float = 1e-3) -> tuple[Column, Column]:
    """A side of a box, widened."""
    low, high = _col(low), _col(high)
    by = F.greatest(F.lit(least), (high - low) * share)
    return low - by, high + by


def convexity(n1, n2, mid, centre, faces) -> Column:
    """0 for smooth or not two-sided edges, else the side of the solid's centre the edge lies on."""
    side = dot(F.zip_with(_col(n1), _col(n2), lambda x, y: x + y), subtract(mid, centre))
    return F.when((_col(faces) != 2) | (dot(n1, n2) > 0.999), 0.0).when(side > 0, 1.0).otherwise(-1.0)


# --- vocabulary ------------------------------------------------------------


def normalize_op(name) -> Column:
    return F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))


def is_commit_op(name) -> Column:
    return normalize_op(name).isin(COMMIT_OPS)


def canonical_command(name) -> Column:
    """Null if unmapped."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), normalize_op(name))


def command_id(name) -> Column:
    ids = F.create_map(*[F.lit(x) for alias, c in ALIASES.items() for x in (alias, COMMANDS.index(c))])
    return F.coalesce(F.try_element_at(ids, normalize_op(name)), F.lit(OTHER))


def command_name(cmd_id) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in COMMANDS]), _col(cmd_id).cast("int")), F.lit("OTHER"))


def ref_kind_name(kind) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(k) for k in REF_KINDS]), _col(kind).cast("int")), F.lit("UNKNOWN"))


# --- parsing ---------------------------------------------------------------

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text) -> Column:
    """Pure numeric text as a double, else null: no flags, selectors, suffixes, inf or nan."""
    t = F.trim(_col(text))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def numeric_args(args, kwargs=None) -> Column:
    """Numbers of positional, then keyword arguments, in order."""
    values = _col(args) if kwargs is None else F.concat(_col(args), F.transform(_col(kwargs), lambda kv: kv["v"]))
    return F.filter(F.transform(values, number), lambda x: x.isNotNull())


def split_of(part_id, train_ratio: float = 0.9) -> Column:
    """train or val by the first 32 bits of the id's MD5."""
    bucket = F.conv(F.substring(F.md5(_col(part_id).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < int(train_ratio * 100), "train").otherwise("val")


def split_alias(split) -> Column:
    split = _col(split)
    return F.when(split == "validation", "val").otherwise(split)


def error_status(error, stage: str = "runtime") -> Column:
    """Status of an error text; null errors are a success."""
    error = _col(error)
    low = F.lower(error)
    return F.when(error.isNull(), "success").when(low.contains("syntaxerror") | low.contains("syntax error"), "syntax_error").when(low.contains("unsupported"), "unsupported_operation").when(low.contains("timeout"), "timeout").otherwise(f"{stage}_error")


def percent(part, whole) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(_col(part) * F.lit(100.0), _col(whole)), F.lit(0.0))


def short_id(part_id, n: int = 8) -> Column:
    return F.substring(_col(part_id).cast("string"), 1, n)


# --- action summary --------------------------------------------------------


def action_summary(ref_points, ref_dirs, numbers, origin=None, z_dir=None) -> Column:
    """struct(params_raw, params, param_mask) of an action, 12 entries each: mean reference
    position (or the workplane's origin), mean unit direction (or its normal), six metric
    arguments. Unset entries are 0 and masked out."""
    none = F.lit(None).cast("array<double>")
    position = F.coalesce(centroid(ref_points), none if origin is None else F.transform(_col(origin), lambda x: x.cast("double")))
    direction = F.coalesce(let(centroid(ref_dirs), lambda mean: F.when(mean.isNotNull(), normalize(mean))), none if z_dir is None else F.transform(_col(z_dir), lambda x: x.cast("double")))
    zeros = F.array(*[F.lit(0.0)] * 3)

    def summary(p: Column, d: Column, numbers: Column) -> Column:
        raw = F.concat(F.coalesce(p, zeros), F.coalesce(d, zeros), pad(numbers, METRIC_ARGS))
        scaled = F.concat(F.coalesce(F.transform(p, lambda x: squash(x)), zeros), F.coalesce(d, zeros), pad(F.transform(numbers, lambda x: symlog(x)), METRIC_ARGS))
        mask = F.concat(F.array_repeat(p.isNotNull(), 3), F.array_repeat(d.isNotNull(), 3), F.transform(F.sequence(F.lit(1), F.lit(METRIC_ARGS)), lambda i: i <= F.size(numbers)))
        return F.struct(nan_to_num_array(raw, *BOUNDS["params_raw"]).alias("params_raw"), nan_to_num_array(scaled, *BOUNDS["params"]).alias("params"), mask.alias("param_mask"))

    return let(position, lambda p: let(direction, lambda d: let(F.slice(_col(numbers), 1, METRIC_ARGS), lambda n: summary(p, d, n))))


assert PARAMS == 6 + METRIC_ARGS
