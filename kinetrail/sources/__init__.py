"""Raw parts and trajectory shards."""

from . import parts, shards

__all__ = ["parts", "shards"]
