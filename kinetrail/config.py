"""Configuration: named groups with defaults and dotted overrides."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

GROUPS: dict[str, dict[str, dict[str, Any]]] = {
    "data": {
        "trajectories": {"uv_grid": 16, "curve_samples": 16, "face_dims": 32, "edge_dims": 16, "surface_channels": 7, "curve_channels": 6, "step_horizon": 1, "image_size": 224, "batch_size": 8},
        "debug": {"uv_grid": 4, "curve_samples": 4, "face_dims": 32, "edge_dims": 16, "surface_channels": 7, "curve_channels": 6, "step_horizon": 1, "image_size": 32, "batch_size": 2},
    },
    "model": {"dummy": {"hidden": 64}, "brep_encoder": {"pointer_dims": 128, "output_dims": 1024, "heads": 8, "layers": 3, "seed": 0}},
    "preprocess": {"default": {"split": "train", "overwrite": False, "timeout_s": 15, "max_shards": None, "max_parts": None, "train_ratio": 0.9}},
}
DEFAULTS = {"data": "trajectories", "model": "brep_encoder", "preprocess": "default"}


def compose(overrides: list[str] | None = None) -> dict[str, dict[str, Any]]:
    """`group=option` selects, `group.key=value` sets; unknown names are errors."""
    chosen, values = dict(DEFAULTS), []
    for item in overrides or []:
        name, _, value = item.partition("=")
        if "." in name:
            values.append((*name.split(".", 1), value))
        elif name in GROUPS and value in GROUPS[name]:
            chosen[name] = value
        else:
            raise KeyError(item)
    config = {group: deepcopy(GROUPS[group][option]) for group, option in chosen.items()}
    for group, key, value in values:
        if key not in config.get(group, {}):
            raise KeyError(f"{group}.{key}")
        config[group][key] = _parsed(value)
    return config


def _parsed(value: str) -> Any:
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "none": None}.get(value.lower(), value)


def select(config: dict, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config
