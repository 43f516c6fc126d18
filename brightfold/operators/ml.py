"""Softmax regression and layers over arrays, as higher-order functions; a model's weights are literals (classes x features, of fixed size)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import cut


def log_softmax(x: str) -> Column:
    """x - log(sum(exp(x))), shifted by the largest so that nothing overflows."""
    total = f"aggregate({x}, 0D, (_sum, _v) -> _sum + exp(_v - _most))"
    # a one-element array binds what is computed once a row, to names that no column has
    return F.expr(f"transform(array(array_max({x})), _most -> transform(array(_most + ln({total})), _log -> transform({x}, _v -> _v - _log))[0])[0]")


def dot(x: str, w: str) -> str:
    return f"aggregate(zip_with({x}, {w}, (a, b) -> a * b), 0D, (s, v) -> s + v)"


def linear(x: str, weights: np.ndarray, bias: np.ndarray) -> Column:
    rows = ", ".join(f"{dot(x, 'array(' + ', '.join(f'{float(v)!r}D' for v in w) + ')')} + {float(b)!r}D" for w, b in zip(weights, bias))
    return F.expr(f"array({rows})")


def layer_norm(x: str, eps: float = 1e-5) -> Column:
    mean = f"aggregate({x}, 0D, (_sum, _v) -> _sum + _v) / size({x})"
    deviation = f"sqrt(aggregate({x}, 0D, (_sum, _v) -> _sum + (_v - _mean) * (_v - _mean)) / size({x}) + {eps!r}D)"
    # a one-element array binds what is computed once a row, to names that no column has
    return F.expr(f"transform(array({mean}), _mean -> transform(array({deviation}), _dev -> transform({x}, _v -> (_v - _mean) / _dev))[0])[0]")


def gradient(df: DataFrame, features: str, label: str, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sums over the rows, in one pass: the loss's gradient by weights (classes x (features + 1)), the loss, and the number of rows. A task
    returns one matrix, so what is collected doesn't grow with the rows."""

    def part(batches):
        import pandas as pd

        total, loss, n = np.zeros_like(weights), 0.0, 0
        for b in batches:
            if len(b):
                x = np.column_stack([np.stack(b[features].to_numpy()).astype(float), np.ones(len(b))])
                y = b[label].to_numpy()
                z = x @ weights.T
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                loss -= np.log(p[np.arange(len(y)), y]).sum()
                p[np.arange(len(y)), y] -= 1
                total += p.T @ x
                n += len(y)
        yield pd.DataFrame({"i": [0], "g": [total.reshape(-1)], "loss": [loss], "n": [n]})

    sums = df.select(features, label).mapInPandas(part, "i int, g array<double>, loss double, n long")
    r = sums.select("n", "loss", F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).orderBy("k").collect()
    if not r:
        return np.zeros_like(weights), 0.0, 0
    return np.array([x["g"] for x in r]).reshape(weights.shape), r[0]["loss"], r[0]["n"]


def train_softmax(df: DataFrame, features: str, label: str, classes: int, dim: int, rate: float, epochs: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Full-batch gradient descent, a pass an epoch."""
    w, losses = np.zeros((classes, dim + 1)), []
    for _ in range(epochs):
        g, loss, n = gradient(df, features, label, w.copy())
        losses.append(loss / max(1, n))
        w -= rate * g / max(1, n)
    return w[:, :-1], w[:, -1], losses


def train_batches(df: DataFrame, key: str, features: str, label: str, classes: int, dim: int, rate: float, epochs: int, size: int = 64, momentum: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Mini-batch descent in order, with momentum: a batch is a range of `size` keys (the last may be shorter, an empty one makes no step). Each step
    needs the weights of the one before, so an epoch is one pass of one task over the rows in order, which holds an Arrow batch and a
    mini-batch at a time. A rows-weighted mean loss an epoch, taken as the weights were at each step."""
    w, losses = np.zeros((classes, dim + 1)), []
    speed = np.zeros_like(w)
    first = df.agg(F.min(key)).first()[0]
    if first is None:
        return w[:, :-1], w[:, -1], [0.0] * epochs
    rows = cut(df.where(F.col(key).isNotNull()).select(F.floor((F.col(key) - first) / size).alias("step"), features, label).repartition(1).sortWithinPartitions("step"))

    def epoch(batches):
        import pandas as pd

        now, fast, total, seen, held = w, speed, 0.0, 0, None

        def take(x, y):
            nonlocal now, fast, total, seen
            z = x @ now.T
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            total -= np.log(p[np.arange(len(y)), y]).sum()
            p[np.arange(len(y)), y] -= 1
            fast = momentum * fast + p.T @ x / len(y)
            now = now - rate * fast
            seen += len(y)

        for b in batches:
            if len(b):
                step, y = b["step"].to_numpy(), b[label].to_numpy()
                x = np.column_stack([np.stack(b[features].to_numpy()).astype(float), np.ones(len(b))])
                if held is not None:
                    step, x, y = np.concatenate([held[0], step]), np.concatenate([held[1], x]), np.concatenate([held[2], y])
                starts = [0, *np.flatnonzero(step[1:] != step[:-1]) + 1]
                for i, j in zip(starts, starts[1:]):
                    take(x[i:j], y[i:j])
                held = step[starts[-1] :], x[starts[-1] :], y[starts[-1] :]
        if held is not None:
            take(*held[1:])
            yield pd.DataFrame({"w": [now.reshape(-1)], "speed": [fast.reshape(-1)], "total": [total], "seen": [seen]})

    for _ in range(epochs):
        r = rows.mapInPandas(epoch, "w array<double>, speed array<double>, total double, seen long").first()
        w, speed = (np.array(x).reshape(w.shape) for x in (r.w, r.speed))
        losses.append(r.total / max(1, r.seen))
    return w[:, :-1], w[:, -1], losses


def convolve(images: np.ndarray, kernels: np.ndarray, stride: int = 2) -> np.ndarray:
    """Images (n, channels, side, side) under kernels (out, channels, 3, 3), padded by one, then ReLU."""
    x = np.pad(images, ((0, 0), (0, 0), (1, 1), (1, 1)))
    patches = np.lib.stride_tricks.sliding_window_view(x, (3, 3), (2, 3))[:, :, ::stride, ::stride]
    return np.maximum(0, np.einsum("ncijkl,ockl->noij", patches, kernels))
