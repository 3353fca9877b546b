"""Operation streams."""

from . import oplog

__all__ = ["oplog"]
