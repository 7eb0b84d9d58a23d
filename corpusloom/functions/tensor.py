"""Vector operators: numpy kernels over Arrow batches of array columns.

Weights are small and captured by the function; sequences (attention) are
groups whose length is the model's context, not the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x):
    z = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + z), z / (1 + z))


def silu(x):
    return x * sigmoid(x)


def softmax(x, axis=-1):
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def linear(x, w):
    """x times the transpose of w (out, in)."""
    return x @ w.T


def rmsnorm(x, gain, eps=1e-5):
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + eps) * gain


def rope(x, positions, theta=10_000.0):
    """Pairs (2k, 2k+1) turned by position / theta^(2k/d)."""
    d = x.shape[-1]
    if d % 2:
        raise ValueError("rotary positions need an even width")
    angle = np.asarray(positions, float)[..., None] * theta ** (-np.arange(0, d, 2) / d)
    c, s = np.cos(angle), np.sin(angle)
    out = np.empty_like(x)
    out[..., 0::2] = x[..., 0::2] * c - x[..., 1::2] * s
    out[..., 1::2] = x[..., 0::2] * s + x[..., 1::2] * c
    return out


def default_d_ff(d: int) -> int:
    """8/3 d, to the nearest multiple of 64, at least 64."""
    return max(64, int((8 * d / 3 + 32) // 64) * 64)


def swiglu(x, w1, w2, w3):
    return linear(silu(linear(x, w1)) * linear(x, w3), w2)


def attention(q, k, v, mask=None):
    """softmax(q k' / sqrt d) v over the last two axes; mask: True where attention is allowed."""
    scores = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        scores = np.where(mask, scores, -np.inf)
    return softmax(scores) @ v


def multi_head(x, wq, wk, wv, wo, heads: int, positions=None, theta=10_000.0):
    """Causal self-attention of a sequence (length, d); rotary if positions are given."""
    n, d = x.shape
    if d % heads:
        raise ValueError("the width is no multiple of the heads")

    def split(y):
        return y.reshape(n, heads, -1).swapaxes(0, 1)

    q, k, v = (split(linear(x, w)) for w in (wq, wk, wv))
    if positions is not None:
        q, k = rope(q, positions, theta), rope(k, positions, theta)
    out = attention(q, k, v, np.tril(np.ones((n, n), bool)))
    return linear(out.swapaxes(0, 1).reshape(n, -1), wo)


def block(x, w: dict, heads: int, theta=10_000.0):
    """Pre-norm transformer block with rotary positions."""
    at = np.arange(len(x))
    y = x + multi_head(rmsnorm(x, w["ln1"]), w["q"], w["k"], w["v"], w["o"], heads, at, theta)
    return y + swiglu(rmsnorm(y, w["ln2"]), w["w1"], w["w2"], w["w3"])


def language_model(ids, w: dict, heads: int, theta=10_000.0):
    """Logits (length, vocabulary) of a sequence of ids."""
    x = w["embedding"][np.asarray(ids)]
    for layer in w["layers"]:
        x = block(x, layer, heads, theta)
    return linear(rmsnorm(x, w["ln_final"]), w["lm_head"])


def truncated_normal(shape, sigma: float, seed: int):
    """Normal values within three sigma, by redrawing."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0, sigma, shape)
    while (bad := np.abs(out) > 3 * sigma).any():
        out[bad] = rng.normal(0, sigma, int(bad.sum()))
    return out


def linear_init(d_out: int, d_in: int, seed: int = 0):
    return truncated_normal((d_out, d_in), (2 / (d_in + d_out)) ** 0.5, seed)


# --- on DataFrames ---


def map_vectors(f, *columns: Column) -> Column:
    """A column of vectors: f(matrix of the first column, further columns as arrays)."""

    @F.pandas_udf("array<double>")
    def run(*series: pd.Series) -> pd.Series:
        if not len(series[0]):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, float) for v in series[0]])
        return pd.Series(list(f(x, *(s.to_numpy() for s in series[1:]))))

    return run(*columns)


def map_sequences(frame: DataFrame, f, key: str, position: str, vector: str = "x") -> DataFrame:
    """(key, position, y): f(matrix of a sequence in order) for each sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        y = f(np.stack([np.asarray(v, float) for v in pdf[vector]]))
        return pd.DataFrame({key: pdf[key], position: pdf[position], "y": list(y)})

    return frame.groupBy(key).applyInPandas(run, f"{key} long, {position} long, y array<double>")
