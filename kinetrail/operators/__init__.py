"""Relational operators over parts, states, faces, edges and actions."""

from . import batching, graph, messages, stats, transitions, validate

__all__ = ["batching", "graph", "messages", "stats", "transitions", "validate"]
