"""The graph encoder over face graphs, as a DataFrame operator.

`layers` counts as in the description it follows: layers - 1 rounds of node and edge
convolution. Attention stays inside a graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from . import layers as L


class Encoder:
    def __init__(self, curve_channels: int = 6, surface_channels: int = 7, pointer: int = 128, outputs: int = 1024, heads: int = 8, rounds: int = 3, seed: int = 0):
        w = L.Weights(seed)
        self.outputs = outputs
        self.curve, self.surface = L.grid_encoder(w, curve_channels, pointer, 1), L.grid_encoder(w, surface_channels, pointer, 2)
        self.fuse_edges, self.fuse_outputs = L.fuse(w, pointer), L.fuse(w, outputs)
        self.node_convs, self.edge_convs = [], []
        for _ in range(rounds - 1):
            self.node_convs.append((L.nn_conv(w, pointer, pointer, pointer), w.mlp(2, pointer, pointer, pointer)))
            self.edge_convs.append((w.mlp(1, pointer, pointer, pointer), w.mlp(2, pointer, pointer, pointer), w.attention(pointer, pointer, heads)))
        self.edge_decoder, self.node_decoder = L.decoder(w, pointer, outputs), L.decoder(w, pointer, outputs)

    def forward(self, uv: np.ndarray, u: np.ndarray, src: np.ndarray, dst: np.ndarray, reverse: np.ndarray) -> dict[str, np.ndarray]:
        """Of one graph: uv [faces, channels, G, G], u [directed edges, channels, U]."""
        nodes = node_pointer = self.surface(uv)
        edges = edge_pointer = self.fuse_edges(self.curve(u), reverse)
        for (conv, mlp), (project, mix, attend) in zip(self.node_convs, self.edge_convs, strict=True):
            nodes = L.leaky(L.batch_norm(mlp(conv(src, dst, nodes, edges))))
            if len(edges):
                joined = mix(edges + project(nodes[src]) + project(nodes[dst]))
                edges = L.leaky(L.batch_norm(joined) + L.layer_norm(attend(edges, nodes) + edges))
                edges = self.fuse_edges(edges, reverse)
        once = np.arange(len(src)) < reverse
        decoded = self.fuse_outputs(self.edge_decoder(edges), reverse) if len(edges) else np.zeros((0, self.outputs))
        return {"edge_pointer": edge_pointer[once], "edge": decoded[once], "edge_index": np.nonzero(once)[0], "node_pointer": node_pointer, "node": self.node_decoder(nodes)}


SCHEMA = "part_id string, step int, kind string, idx int, pointer array<double>, embedding array<double>"


def embed(faces: DataFrame, adjacency: DataFrame, edges: DataFrame, grid: int, samples: int, **options) -> DataFrame:
    """Pointers and embeddings of every face and undirected edge.

    faces: part_id, step, face_idx, uv; adjacency: src, dst, edge_idx, adj_idx, reverse_idx;
    edges: edge_idx, u. Each graph's children are nested by one aggregation per table, then a
    task maps whole graphs; graphs are small, so no group is unbounded by the data's size.
    """
    keys = ["part_id", "step"]
    nodes = faces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("face_idx", "uv"))).alias("nodes"))
    directed = adjacency.join(edges.select(*keys, "edge_idx", "u"), [*keys, "edge_idx"])
    links = directed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("adj_idx", "src", "dst", "reverse_idx", "u"))).alias("links"))
    channels = {"surface_channels": 7, "curve_channels": 6} | {k: v for k, v in options.items() if k in ("surface_channels", "curve_channels")}

    def run(batches):
        model = Encoder(**{**options, **channels})
        for batch in batches:
            for row in batch.itertuples(index=False):
                uv = np.array([n["uv"] for n in row.nodes], float).reshape(len(row.nodes), channels["surface_channels"], grid, grid)
                edges = [] if row.links is None else list(row.links)
                u = np.array([e["u"] for e in edges], float).reshape(len(edges), channels["curve_channels"], samples)
                src, dst, reverse = (np.array([e[k] for e in edges], int) for k in ("src", "dst", "reverse_idx"))
                found = model.forward(uv, u, src, dst, reverse)
                out = [(row.part_id, row.step, "face", i, p, e) for i, (p, e) in enumerate(zip(found["node_pointer"], found["node"], strict=True))]
                out += [(row.part_id, row.step, "edge", int(i), p, e) for i, p, e in zip(found["edge_index"], found["edge_pointer"], found["edge"], strict=True)]
                yield pd.DataFrame(out, columns=["part_id", "step", "kind", "idx", "pointer", "embedding"])  # a graph at a time: embeddings are wide

    ship(faces.sparkSession)
    return nodes.join(links, keys, "left").mapInPandas(run, SCHEMA)


def normalize_images(images: DataFrame, imagenet: bool = False, size: int | None = None) -> DataFrame:
    """Pixels in 0..1 (or standardized by channel, planes of equal size): adds `values` array<float>."""
    mean, std = (np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])) if imagenet else (np.zeros(3), np.ones(3))

    @F.pandas_udf("array<float>")
    def scaled(pixels: pd.Series) -> pd.Series:
        planes = [np.frombuffer(p, np.uint8).reshape(3, -1) / 255.0 for p in pixels]
        return pd.Series([((x - mean[:, None]) / std[:, None]).reshape(-1).astype(np.float32) for x in planes])

    ship(images.sparkSession)
    return images.withColumn("values", scaled("pixels"))


def to_planes(images: DataFrame, size: int) -> DataFrame:
    """Interleaved RGB or RGBA pixels to three planes; pixels of another length become the blank canvas."""

    @F.pandas_udf("binary")
    def planes(pixels: pd.Series) -> pd.Series:
        def one(p) -> bytes:
            n = size * size
            if p is None or len(p) not in (3 * n, 4 * n):
                return bytes([220]) * (3 * n)
            return np.frombuffer(p, np.uint8).reshape(n, -1)[:, :3].T.tobytes()

        return pd.Series([one(p) for p in pixels])

    ship(images.sparkSession)
    return images.withColumn("pixels", planes("pixels"))
