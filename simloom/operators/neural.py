"""Learned embeddings: neighbourhood propagation in DataFrames, and small numpy trainers.

There is no deep-learning library here. GraphSAGE and Deep Graph Infomax are trained by hand-derived
gradients on a graph that the driver holds, behind a check of its size; propagation itself is a join
and an aggregate and has no such bound. Results can't equal another library's draws; tests look at
falling losses, shapes and determinism.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.graph import degrees, symmetric


def sage_mean(edges: DataFrame, features: DataFrame, column: str = "features") -> DataFrame:
    """(nid, own, mean): each node's vector and the mean of its neighbours' vectors."""
    long = features.select("nid", F.posexplode(column).alias("d", "x"))
    both = symmetric(edges)
    summed = both.join(long.withColumnRenamed("nid", "n"), "n").groupBy("v", "d").agg(F.avg("x").alias("x"))
    mean = summed.groupBy(F.col("v").alias("nid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))
    return features.select("nid", F.col(column).alias("own")).join(mean, "nid", "left")


def gcn(edges: DataFrame, features: DataFrame, column: str = "features") -> DataFrame:
    """(nid, out): symmetric-normalised propagation with self loops, sum of x_u / sqrt((d_u + 1)(d_v + 1))."""
    deg = features.select("nid").join(degrees(edges), "nid", "left").select("nid", (F.coalesce("deg", F.lit(0)) + 1).alias("d1"))
    arcs = symmetric(edges).select("v", "n").unionAll(features.select(F.col("nid").alias("v"), F.col("nid").alias("n")))
    arcs = arcs.join(deg.select(F.col("nid").alias("v"), F.col("d1").alias("dv")), "v").join(deg.select(F.col("nid").alias("n"), F.col("d1").alias("dn")), "n")
    long = features.select(F.col("nid").alias("n"), F.posexplode(column).alias("d", "x"))
    summed = arcs.join(long, "n").groupBy("v", "d").agg(F.sum(F.col("x") / F.sqrt(F.col("dv") * F.col("dn"))).alias("x"))
    return summed.groupBy(F.col("v").alias("nid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("out"))


# ---------------------------------------------------------------- numpy trainers


class _Adam:
    def __init__(self, weights: list[np.ndarray], rate: float = 1e-3):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _glorot(rng, a: int, b: int) -> np.ndarray:
    return rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Adjacency:
    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.argsort(a, kind="stable")
        self.n, self.col, self.starts = n, b[order], np.searchsorted(a[order], np.arange(n + 1))
        self.deg = np.diff(self.starts)

    def draw(self, rng, nodes: np.ndarray, k: int) -> np.ndarray:
        """k neighbours of each node with replacement; a node without any draws itself."""
        pick = (rng.random((len(nodes), k)) * self.deg[nodes][:, None]).astype(np.int64)
        if not len(self.col):
            return np.repeat(nodes[:, None], k, axis=1)
        found = self.col[np.minimum(self.starts[nodes][:, None] + pick, len(self.col) - 1)]
        return np.where(self.deg[nodes][:, None] > 0, found, nodes[:, None])

    def normalised(self, x: np.ndarray) -> np.ndarray:
        """D^-1/2 (A + I) D^-1/2 x; its own transpose."""
        scale = 1 / np.sqrt(self.deg + 1)[:, None]
        y = x * scale
        out = y.copy()
        full = np.flatnonzero(self.deg)
        if len(full):
            out[full] += np.add.reduceat(y[self.col], self.starts[full], axis=0)
        return out * scale


def _levels(adj: _Adjacency, rng, nodes: np.ndarray, samples) -> list[np.ndarray]:
    """The nodes, their drawn neighbours, these ones' neighbours and so on, end to end level by level."""
    out = [nodes]
    for k in samples:
        out.append(adj.draw(rng, out[-1], k).ravel())
    return out


def sage_forward(w: list[np.ndarray], x: np.ndarray, levels: list[np.ndarray], samples) -> tuple[np.ndarray, tuple]:
    """Vectors of unit length of the first level's nodes, and what the gradient needs.

    w holds for each layer the weights of the node, those of its neighbours' mean, and the bias. Hidden
    layers end in relu.
    """
    depth, held, kept = len(samples), [x[f] for f in levels], []
    for k in range(depth):
        own_w, near_w, bias = w[3 * k : 3 * k + 3]
        layer, out = [], []
        for i in range(depth - k):
            near = held[i + 1].reshape(len(held[i]), samples[i], -1).mean(axis=1)
            raw = np.hstack([held[i] @ own_w, near @ near_w]) + bias
            layer.append((held[i], near, raw))
            out.append(raw if k == depth - 1 else np.maximum(raw, 0))
        kept.append(layer)
        held = out
    size = np.sqrt((held[0] ** 2).sum(axis=1, keepdims=True)) + 1e-12
    return held[0] / size, (kept, held[0] / size, size)


def sage_backward(w: list[np.ndarray], grad: np.ndarray, state: tuple, samples) -> list[np.ndarray]:
    """The gradient by w, given that by the unit vectors."""
    kept, unit, size = state
    depth = len(samples)
    back, out = [(grad - unit * (grad * unit).sum(axis=1, keepdims=True)) / size], [None] * (3 * depth)
    for k in reversed(range(depth)):
        own_w, near_w, bias = w[3 * k : 3 * k + 3]
        half, sums = own_w.shape[1], [np.zeros_like(own_w), np.zeros_like(near_w), np.zeros_like(bias)]
        below: list = [0.0] * (depth - k + 1)
        for i, (own, near, raw) in enumerate(kept[k]):
            d = back[i] if k == depth - 1 else back[i] * (raw > 0)
            sums[0] += own.T @ d[:, :half]
            sums[1] += near.T @ d[:, half:]
            sums[2] += d.sum(axis=0)
            if k:
                below[i] = below[i] + d[:, :half] @ own_w.T
                below[i + 1] = below[i + 1] + np.repeat(d[:, half:] @ near_w.T / samples[i], samples[i], axis=0)
        out[3 * k : 3 * k + 3], back = sums, below
    return out


def sage_loss(w: list[np.ndarray], x: np.ndarray, ends: tuple[list, list], label: np.ndarray, samples) -> tuple[float, list[np.ndarray]]:
    """Cross entropy of telling pairs that meet on walks (label 1) from random ones, and its gradient by w.

    ends: the levels of each end of the pairs. The last two of w are the link's weights and bias.
    """
    (u, su), (v, sv) = (sage_forward(w, x, e, samples) for e in ends)
    both = np.hstack([u, v])
    p = _sigmoid((both @ w[-2])[:, 0] + w[-1])
    loss = float(-(label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12)).mean())
    d = ((p - label) / len(label))[:, None]
    back, width = d @ w[-2].T, u.shape[1]
    grads = [a + b for a, b in zip(sage_backward(w, back[:, :width], su, samples), sage_backward(w, back[:, width:], sv, samples))]
    return loss, [*grads, both.T @ d, d.sum(axis=0)]


def sage_weights(rng, width: int, layers) -> list[np.ndarray]:
    out = []
    for h in layers:
        out += [_glorot(rng, width, h - h // 2), _glorot(rng, width, h // 2), np.zeros(h)]
        width = h
    return [*out, _glorot(rng, 2 * width, 1), np.zeros(1)]


def train_sage(x: np.ndarray, src: np.ndarray, dst: np.ndarray, layers=(256, 128), samples=(10, 5), walks: int = 1, length: int = 5, batch: int = 512, epochs: int = 1, seed: int = 11) -> tuple[np.ndarray, list[float]]:
    """Embeddings (unit length) and the loss of each batch: mean-aggregator layers with a bias, as many as
    there are sizes, trained to tell nodes that meet on random walks from random pairs."""
    if len(layers) != len(samples) or not layers or min(layers) < 2:
        raise ValueError("one number of samples for each layer, and layers of 2 and more")
    rng = np.random.default_rng(seed)
    adj, n = _Adjacency(src, dst, len(x)), len(x)
    w = sage_weights(rng, x.shape[1], layers)
    adam, losses = _Adam(w), []
    for _ in range(epochs):
        starts = np.repeat(np.arange(n), walks)
        at, pairs = starts, []
        for _ in range(length - 1):
            at = adj.draw(rng, at, 1)[:, 0]
            pairs.append(np.stack([starts, at], axis=1))
        good = np.concatenate(pairs)
        bad = np.stack([good[:, 0], rng.choice(n, len(good), p=(adj.deg + 1e-9) ** 0.75 / ((adj.deg + 1e-9) ** 0.75).sum())], axis=1)
        every, label = np.concatenate([good, bad]), np.repeat([1.0, 0.0], len(good))
        for rows in np.array_split(rng.permutation(len(every)), max(1, len(every) // batch)):
            ends = tuple(_levels(adj, rng, every[rows, k], samples) for k in (0, 1))
            loss, grads = sage_loss(w, x, ends, label[rows], samples)
            losses.append(loss)
            adam.step(grads)
    parts = [sage_forward(w, x, _levels(adj, rng, np.arange(a, min(n, a + batch)), samples), samples)[0] for a in range(0, n, batch)]
    return np.concatenate(parts) if parts else np.zeros((0, layers[-1])), losses


#: Each activation and its derivative, by the sum before it and the value after it.
ACTIVATIONS = {
    "linear": (lambda z: z, lambda z, h: np.ones_like(z)),
    "relu": (lambda z: np.maximum(z, 0), lambda z, h: (z > 0) * 1.0),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0))), lambda z, h: np.where(z > 0, 1.0, h + 1)),
    "tanh": (np.tanh, lambda z, h: 1 - h * h),
    "sigmoid": (_sigmoid, lambda z, h: h * (1 - h)),
    "softplus": (lambda z: np.logaddexp(0, z), lambda z, h: _sigmoid(z)),
}


def gcn_forward(w: list[np.ndarray], adj: _Adjacency, x: np.ndarray, activations) -> tuple[np.ndarray, list[tuple]]:
    """Propagation layers, each with weights and a bias in w and an activation; and what the gradient needs."""
    kept = []
    for k, name in enumerate(activations):
        near = adj.normalised(x)
        raw = near @ w[2 * k] + w[2 * k + 1]
        x = ACTIVATIONS[name][0](raw)
        kept.append((near, raw, x))
    return x, kept


def gcn_backward(w: list[np.ndarray], adj: _Adjacency, grad: np.ndarray, kept: list[tuple], activations) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for k in reversed(range(len(activations))):
        near, raw, h = kept[k]
        grad = grad * ACTIVATIONS[activations[k]][1](raw, h)
        out[:0] = [near.T @ grad, grad.sum(axis=0)]
        if k:
            grad = adj.normalised(grad @ w[2 * k].T)
    return out


def dgi_loss(w: list[np.ndarray], adj: _Adjacency, x: np.ndarray, shuffled: np.ndarray, activations) -> tuple[float, list[np.ndarray]]:
    """Cross entropy of telling nodes from nodes with shuffled features by their fit to the mean of all, and its gradient by w."""
    n, last = len(x), w[-1]
    (h, kh), (f, kf) = gcn_forward(w, adj, x, activations), gcn_forward(w, adj, shuffled, activations)
    s = _sigmoid(h.mean(axis=0))
    ws = last @ s
    p, q = _sigmoid(h @ ws), _sigmoid(f @ ws)
    loss = float(-(np.log(p + 1e-12).mean() + np.log(1 - q + 1e-12).mean()) / 2)
    dp, dq = (p - 1) / (2 * n), q / (2 * n)
    g_ws = h.T @ dp + f.T @ dq
    g_mean = (last.T @ g_ws) * s * (1 - s)
    real = gcn_backward(w, adj, np.outer(dp, ws) + g_mean / n, kh, activations)
    false = gcn_backward(w, adj, np.outer(dq, ws), kf, activations)
    return loss, [*(a + b for a, b in zip(real, false)), np.outer(g_ws, s)]


def train_dgi(x: np.ndarray, src: np.ndarray, dst: np.ndarray, layers=(512,), activations=("relu",), epochs: int = 20, patience: int = 20, seed: int = 12, width: int = 0) -> tuple[np.ndarray, list[float]]:
    """Embeddings and the loss of each epoch: propagation layers with the given sizes and activations.

    width is short for one layer of that size.
    """
    layers = (width,) if width else layers
    if len(layers) != len(activations) or not layers:
        raise ValueError("one activation for each layer")
    if unknown := set(activations) - set(ACTIVATIONS):
        raise ValueError(f"an activation is one of {', '.join(ACTIVATIONS)}, not {', '.join(sorted(unknown))}")
    rng = np.random.default_rng(seed)
    adj, n, width = _Adjacency(src, dst, len(x)), len(x), x.shape[1]
    w: list[np.ndarray] = []
    for h in layers:
        w += [_glorot(rng, width, h), np.zeros(h)]
        width = h
    w.append(_glorot(rng, width, width))
    adam, losses, best = _Adam(w), [], (np.inf, 0)
    for epoch in range(epochs):
        loss, grads = dgi_loss(w, adj, x, x[rng.permutation(n)], activations)
        losses.append(loss)
        if loss < best[0]:
            best = (loss, epoch)
        elif epoch - best[1] >= patience:
            break
        adam.step(grads)
    return gcn_forward(w, adj, x, activations)[0], losses


def learned(edges: DataFrame, features: DataFrame, kind: str, most_nodes: int = 200_000, **options) -> DataFrame:
    """(nid, emb) by "graphsage" or "deepgraphinfomax"; a graph beyond most_nodes is refused."""
    trainers = {"graphsage": train_sage, "deepgraphinfomax": train_dgi}
    if kind not in trainers:
        raise ValueError(f"an embedding is one of {', '.join(trainers)}")
    if features.count() > most_nodes:
        raise ValueError("the graph is too large for the driver's trainer; propagate with sage_mean() or gcn() instead")
    table = features.select("nid", "features").orderBy("nid").toPandas()
    pairs = edges.select("src", "dst").toPandas()
    ids = table["nid"].to_numpy()
    src, dst = np.searchsorted(ids, pairs["src"]), np.searchsorted(ids, pairs["dst"])
    x = np.array(table["features"].tolist(), float).reshape(len(ids), -1)
    emb, _ = trainers[kind](x, src, dst, **options)
    return edges.sparkSession.createDataFrame(pd.DataFrame({"nid": ids, "emb": list(emb.tolist())}), "nid long, emb array<double>")
