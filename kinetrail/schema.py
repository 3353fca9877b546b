"""Tables, feature names and vocabularies of construction trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import _parse_datatype_string

SCHEMA_VERSION = "0.3.0"
VOCABULARY_VERSION = "0.1.0"
BLANK_PIXEL = 220
PARAMS = 12
METRIC_ARGS = 6

# Canonical commands by id, reference kinds by id, operation aliases, views,
# one-hot groups, statuses, feature names in vector order.
COMMANDS = ["EXTRUDE", "CUT", "HOLE", "CHAMFER", "FILLET", "REVOLVE", "BOX", "CYLINDER", "SPHERE", "LOFT", "SWEEP", "SHELL", "UNION", "INTERSECT", "OFFSET2D", "OTHER"]
OTHER = COMMANDS.index("OTHER")
REF_KINDS = ["REF_NONE", "REF_WORKPLANE", "REF_FACE", "REF_EDGE", "REF_VERTEX"]
ALIASES = {
    "extrude": "EXTRUDE", "twistextrude": "EXTRUDE",
    "cut": "CUT", "cutblind": "CUT", "cutthruall": "CUT", "holethruall": "CUT", "split": "CUT",
    "hole": "HOLE", "cborehole": "HOLE", "cskhole": "HOLE", "csk_face_hole": "HOLE",
    "chamfer": "CHAMFER", "fillet": "FILLET", "revolve": "REVOLVE",
    "box": "BOX", "wedge": "BOX", "cylinder": "CYLINDER", "sphere": "SPHERE",
    "loft": "LOFT", "sweep": "SWEEP", "shell": "SHELL", "offset2d": "OFFSET2D",
    "union": "UNION", "fuse": "UNION", "intersect": "INTERSECT",
    "mirror": "OTHER", "other": "OTHER",
}
COMMIT_OPS = sorted(set(ALIASES) - {"other"})
VIEWS = ["iso", "front", "top", "right"]
SURFACE_GROUPS = {"plane": 0, "cylinder": 1, "cone": 2, "sphere": 3, "torus": 4, "bspline": 5, "bezier": 5, "revolution": 6, "extrusion": 6}
CURVE_GROUPS = {"line": 0, "circle": 1, "ellipse": 2, "parabola": 3, "hyperbola": 3, "bezier": 4, "bspline": 4}
STATUSES = ["success", "syntax_error", "runtime_error", "unsupported_operation", "extraction_error", "render_error", "timeout"]
FACE_FEATURES = (
    "is_plane is_cylinder is_cone is_sphere is_torus is_bspline is_revolution_or_extrusion is_other_surface "
    "area centroid_x centroid_y centroid_z normal_x normal_y normal_z bbox_dx bbox_dy bbox_dz num_wires num_edges orientation "
    "u_range_len v_range_len inertia_ixx inertia_iyy inertia_izz log_area aspect_xy aspect_yz bbox_diagonal is_curved is_multi_loop"
).split()
EDGE_FEATURES = (
    "is_line is_circle is_ellipse is_parabola_hyperbola is_bspline_bezier is_other_curve length midpoint_x midpoint_y midpoint_z "
    "tangent_x tangent_y tangent_z is_closed is_degenerated convexity"
).split()

PROFILE = (
    "struct<num_wires:int,num_outer_loops:int,num_inner_loops:int,total_wire_length:double,points_2d:array<array<float>>,"
    "wires:array<struct<wire_index:int,is_inner_loop:boolean,length:double,center:array<double>,bbox:array<double>>>,"
    "primitives:array<struct<wire_index:int,is_inner_loop:boolean,type:string,start:array<double>,end:array<double>,radius:double>>>"
)

TABLES = {
    "parts": "part_id string, split string, source_shard string, source_row bigint, code string, ops_count int",
    "op_log": "part_id string, step int, depth int, op_name string, args array<string>, kwargs array<struct<k:string,v:string>>",
    "trajectories": "part_id string, source_split string, source_shard string, source_row bigint, num_steps int",
    "states": "part_id string, step int, num_faces int, num_edges int, num_solids int, volume double, surface_area double, bbox array<float>",
    "faces": "part_id string, step int, face_idx int, face_key string, features array<float>, uv array<float>",
    "edges": "part_id string, step int, edge_idx int, edge_key string, features array<float>, u array<float>",
    "face_edge": "part_id string, step int, face_idx int, edge_idx int",
    "face_adjacency": "part_id string, step int, adj_idx int, src int, dst int, edge_idx int, reverse_idx int",
    "images": "part_id string, step int, view string, pixels binary",
    "actions": (
        "part_id string, step int, operation_name string, cmd_id int, params_raw array<float>, params array<float>, param_mask array<boolean>, ref_kind int, "
        "ref_entity_indices array<bigint>, ref_points array<array<float>>, ref_directions array<array<float>>, "
        f"profile {PROFILE}, "
        "tool_geometry struct<tool_type:string>"
    ),
    "part_status": "part_id string, status string, error string, duration_s double",
    "shard_metadata": "source_shard string, split string, schema_version string, vocabulary_version string, attempted int, succeeded int, bytes bigint, created_at timestamp, face_features array<string>, edge_features array<string>, vocabulary array<string>, shapes map<string,array<int>>",
}


def table_type(name: str):
    return _parse_datatype_string(TABLES[name])


def dim_command(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COMMANDS)), "cmd_id int, command string")


def dim_op_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "op_name_lower string, command string")


def dim_ref_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REF_KINDS)), "ref_kind int, name string")


def empty_states(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """S_0 of every part: a constant row, never a computed one. Columns to `keep` follow the part's key."""
    return parts.selectExpr("part_id", *keep, "0 AS step", "0 AS num_faces", "0 AS num_edges", "0 AS num_solids", "0D AS volume", "0D AS surface_area", "array_repeat(CAST(0 AS FLOAT), 6) AS bbox")


def blank_images(parts: DataFrame, size: int = 224) -> DataFrame:
    """The blank canvas of S_0 in every view."""
    views = ", ".join(f"'{v}'" for v in VIEWS)
    pixels = f"unhex(repeat('{BLANK_PIXEL:02X}', {3 * size * size}))"
    return parts.selectExpr("part_id", "0 AS step", f"explode(array({views})) AS view", f"{pixels} AS pixels")
