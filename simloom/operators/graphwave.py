"""Structural node embeddings by heat wavelets (GraphWave).

The heat kernel of the normalised Laplacian is approximated by Chebyshev polynomials and applied to
blocks of unit columns; each column is reduced to its empirical characteristic function at once, so
the n x n kernel never exists. The adjacency is broadcast behind a check of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the method: bounds of the automatic scales, the cut of small entries, and scales for the unweighted form.
ETA_MAX, ETA_MIN, CUT, DEFAULT_SCALES = 0.95, 0.80, 1e-4, (1.0, 10.0, 25.0, 50.0)


def auto_scales(n: int, count: int = 2) -> list[float]:
    """Scales for a graph of n nodes, evenly between both bounds."""
    root = math.sqrt(n / 2)
    return np.linspace(-math.log(ETA_MAX) * root, -math.log(ETA_MIN) * root, count).tolist()


def chebyshev(scale: float, order: int) -> np.ndarray:
    """Coefficients of exp(-scale (x + 1)) on [-1, 1] for polynomials up to the order, the first halved."""
    at = np.cos((2 * np.arange(1, order + 1) - 1) * np.pi / (2 * order))
    base = np.polynomial.chebyshev.chebvander(at, order).T
    out = 2 / order * base @ np.exp(-scale * (at + 1))
    out[0] /= 2
    return out


def laplacian_less_one(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of L - I = -D^-1/2 A D^-1/2 in row order; a node without weight has zeros."""
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    degree = np.bincount(a, w, n)
    scale = np.where(degree > 1e-10, 1 / np.sqrt(np.where(degree > 1e-10, degree, 1)), 0)
    order = np.argsort(a, kind="stable")
    return a[order], b[order], (-scale[a] * w * scale[b])[order]


def _times(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[first]] = np.add.reduceat(values[:, None] * x[cols], first, axis=0)
    return out


def heat_columns(matrix: tuple, n: int, columns: np.ndarray, scales: list[float], order: int) -> list[np.ndarray]:
    """For each scale the given columns of the heat kernel, entries of at most CUT / n set to 0."""
    x = np.zeros((n, len(columns)))
    x[columns, np.arange(len(columns))] = 1
    factors = [chebyshev(s, order) for s in scales]
    before, now = x, _times(*matrix, x)
    out = [c[0] * before + c[1] * now for c in factors]
    for k in range(2, order + 1):
        before, now = now, 2 * _times(*matrix, now) - before
        for o, c in zip(out, factors):
            o += c[k] * now
    return [np.where(o > CUT / n, o, 0.0) for o in out]


def characteristic(column: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each column: mean cos and mean sin of each point times its entries, in turn."""
    out = np.empty((column.shape[1], 2 * len(points)))
    for i, t in enumerate(points):
        out[:, 2 * i], out[:, 2 * i + 1] = np.cos(t * column).mean(axis=0), np.sin(t * column).mean(axis=0)
    return out


def _graph(edges: DataFrame, weighted: bool, most_edges: int):
    m = edges.count()
    if m > most_edges:
        raise ValueError(f"{m} edges don't fit the broadcast adjacency; filter components first")
    table = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).toPandas()
    names, flat = np.unique(table[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
    flat = flat.reshape(-1, 2)
    weight = table["weight"].to_numpy() if weighted else np.ones(m)
    return names, laplacian_less_one(flat[:, 0], flat[:, 1], weight, len(names))


def _over_columns(edges: DataFrame, fn, ddl: str, weighted: bool, most_edges: int, batch: int) -> DataFrame:
    spark = edges.sparkSession
    names, matrix = _graph(edges, weighted, most_edges)
    held = spark.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = held.value
        for part in batches:
            own = part["i"].to_numpy()
            for at in range(0, len(own), batch):
                yield fn(names, matrix, own[at : at + batch])

    n = len(names)
    columns = spark.range(n).withColumnRenamed("id", "i").repartition(max(1, min(-(-n // batch), 1_000_000)))
    return columns.mapInPandas(run, ddl)


def heat_kernel(edges: DataFrame, scale: float, order: int = 30, weighted: bool = True, batch: int = 64, most_edges: int = 20_000_000) -> DataFrame:
    """(src, dst, value): the kernel's entries that aren't cut off."""

    def entries(names, matrix, own):
        heat = heat_columns(matrix, len(names), own, [scale], order)[0]
        i, j = np.nonzero(heat)
        return pd.DataFrame({"src": names[i], "dst": names[own[j]], "value": heat[i, j]})

    return _over_columns(edges, entries, "src long, dst long, value double", weighted, most_edges, batch)


def graphwave(edges: DataFrame, scales: list[float] | None = None, samples: tuple[float, float, int] = (0, 100, 50), order: int = 30, weighted: bool = True, batch: int = 64, most_edges: int = 20_000_000) -> DataFrame:
    """(nid, emb): 2 * points * scales dimensions for each node that has edges.

    Without scales, the weighted form takes two automatic ones and the unweighted one its defaults.
    """
    n = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count()
    scales = list(scales or (auto_scales(max(1, n)) if weighted else DEFAULT_SCALES))
    points = np.linspace(*samples)

    def embed(names, matrix, own):
        heat = heat_columns(matrix, len(names), own, scales, order)
        return pd.DataFrame({"nid": names[own], "emb": list(np.hstack([characteristic(h, points) for h in heat]))})

    return _over_columns(edges, embed, "nid long, emb array<double>", weighted, most_edges, batch)
