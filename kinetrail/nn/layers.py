"""Layers of the encoder in inference form: seeded weights, batch norms with fresh statistics.

Every layer is a function from arrays to arrays with its weights in a closure; a fresh batch
norm scales by 1 / sqrt(1 + eps).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Layer = Callable[[np.ndarray], np.ndarray]
_NORM = 1.0 / math.sqrt(1.0 + 1e-5)
SLOPE = 0.01


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def batch_norm(x: np.ndarray) -> np.ndarray:
    return x * _NORM


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


class Weights:
    """Kaiming-uniform weights in order of demand; equal seeds give equal networks."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def kaiming(self, *shape: int) -> np.ndarray:
        fan_in = int(np.prod(shape[1:]))
        bound = math.sqrt(6.0 / max(fan_in, 1))
        return self.rng.uniform(-bound, bound, shape)

    def linear(self, inputs: int, outputs: int, bias: bool = True) -> Layer:
        w, b = self.kaiming(outputs, inputs), np.zeros(outputs) if bias else None
        return lambda x: x @ w.T if b is None else x @ w.T + b

    def fc(self, inputs: int, outputs: int, bias: bool = False) -> Layer:
        inner = self.linear(inputs, outputs, bias)
        return lambda x: leaky(batch_norm(inner(x)))

    def mlp(self, layers: int, inputs: int, hidden: int, outputs: int) -> Layer:
        if layers < 1:
            raise ValueError("an MLP has one layer at least")
        sizes = [inputs, *[hidden] * (layers - 1), outputs]
        steps = [self.linear(a, b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

        def apply(x: np.ndarray) -> np.ndarray:
            for step in steps[:-1]:
                x = relu(batch_norm(step(x)))
            return steps[-1](x)

        return apply

    def conv(self, inputs: int, outputs: int, dims: int, kernel: int = 3) -> Layer:
        """Same-size convolution over the last 1 or 2 axes, batch norm, leaky ReLU."""
        w = self.kaiming(outputs, inputs, *[kernel] * dims)
        pad = kernel // 2
        axes = "xy"[:dims]

        def apply(x: np.ndarray) -> np.ndarray:
            padded = np.pad(x, [(0, 0), (0, 0)] + [(pad, pad)] * dims)
            windows = np.lib.stride_tricks.sliding_window_view(padded, [kernel] * dims, axis=tuple(range(2, 2 + dims)))
            taps = "uv"[:dims]
            return leaky(batch_norm(np.einsum(f"nc{axes}{taps},oc{taps}->no{axes}", windows, w, optimize=True)))

        return apply

    def attention(self, queries: int, keys: int, heads: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Multi-head attention of queries over keys (also values)."""
        q, k, v, out = self.linear(queries, queries), self.linear(keys, queries), self.linear(keys, queries), self.linear(queries, queries)
        width = queries // heads

        def apply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            split = lambda z: z.reshape(len(z), heads, width).transpose(1, 0, 2)
            scores = split(q(x)) @ split(k(y)).transpose(0, 2, 1) / math.sqrt(width)
            scores = np.exp(scores - scores.max(-1, keepdims=True))
            mixed = scores / scores.sum(-1, keepdims=True) @ split(v(y))
            return out(mixed.transpose(1, 0, 2).reshape(len(x), queries))

        return apply


def grid_encoder(weights: Weights, channels: int, outputs: int, dims: int) -> Layer:
    """Three convolutions (64, 128, 256), average pool, linear block: for curves (1) and surfaces (2)."""
    sizes = [channels, 64, 128, 256]
    convs = [weights.conv(a, b, dims) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    last = weights.fc(256, outputs)

    def apply(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, outputs))
        if x.shape[1] != channels:
            x = np.moveaxis(x, -1, 1)
        for conv in convs:
            x = conv(x)
        return last(x.mean(axis=tuple(range(2, 2 + dims))))

    return apply


def scatter_sum(messages: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, messages.shape[1]))
    np.add.at(out, to, messages)
    return out


def nn_conv(weights: Weights, nodes: int, outputs: int, edges: int, how: str = "sum", residual: bool = True) -> Callable:
    """h_v = sum or mean of h_u W(e), plus a linear residual."""
    if how not in ("sum", "mean"):
        raise NotImplementedError(f"aggregator {how}")
    edge_matrix = weights.linear(edges, nodes * outputs)
    base = weights.linear(nodes, outputs, bias=False) if residual else None

    def apply(src: np.ndarray, dst: np.ndarray, h: np.ndarray, e: np.ndarray) -> np.ndarray:
        sent = np.einsum("ni,nio->no", h[src], edge_matrix(e).reshape(-1, nodes, outputs)) if len(src) else np.zeros((0, outputs))
        out = scatter_sum(sent, dst, len(h))
        if how == "mean":
            out /= np.maximum(np.bincount(dst, minlength=len(h)), 1)[:, None]
        return out + base(h) if base else out

    return apply


def fuse(weights: Weights, dims: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    inner = weights.fc(dims, dims, bias=True)
    return lambda e, reverse: inner(e + e[reverse]) if len(e) else e


def decoder(weights: Weights, inputs: int, outputs: int) -> Layer:
    """512, 256, outputs; dropout is off in inference."""
    a, b, c = weights.linear(inputs, 512, False), weights.linear(512, 256, False), weights.linear(256, outputs)
    return lambda x: c(relu(batch_norm(b(relu(batch_norm(a(x)))))))
