"""Analytics over construction trajectories, graphs and text corpora, on Spark."""

from __future__ import annotations

from importlib import import_module

#: Public names and the modules they are taken from on first use.
_EXPORTS = {
    "run": "preprocess", "tables_of": "preprocess", "compose": "config",
    "scan": "sources.parts", "find_shards": "sources.parts", "trace_back": "sources.parts",
    "read": "sources.shards", "write": "sources.shards", "pending": "sources.shards",
    "extract": "kernel.extract", "adjacency": "operators.graph", "incidence": "operators.graph",
    "transitions": "operators.transitions", "transition_batch": "operators.batching", "collate": "operators.batching", "GraphBatch": "operators.batching",
    "duration_stats": "operators.stats", "embed": "nn.encoder", "fold": "streaming.oplog", "fold_stream": "streaming.oplog",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    module = import_module(f".{_EXPORTS[name]}", __name__)
    # A submodule of the same name is the module; its function is exported under it.
    return getattr(module, name)
