"""Rescored cosine pairs that are made anew in each pass, block by block, and never listed: their number grows with the square of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.candidates import normalised
from simloom.scratch import batch_rows, drop, stored

#: Rows of a chunk, rows of it in a matrix product (these stay in a core's cache), and chunks that a task meets.
CHUNK, SLAB, MEETS = 1024, 128, 64
CHUNK_DDL = "c long, ids binary, x binary, s binary, n binary, p binary"


def _read(row, end: str) -> SimpleNamespace:
    """A chunk: ids, unit vectors x, and of each node the sum s and number n of its cosines and the price p."""
    a = {k: np.frombuffer(getattr(row, f"{k}{end}"), np.int64 if k == "ids" else float) for k in ("ids", "x", "s", "n", "p")}
    return SimpleNamespace(c=getattr(row, f"c{end}"), **a | {"x": a["x"].reshape(len(a["ids"]), -1)})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[SimpleNamespace, SimpleNamespace]]:
    a = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if a is None or a.c != row.c0:
                a = _read(row, "0")
            yield a, _read(row, "1")


#: Values that differ by less are one for the choice of the best; a hash then decides, so that copies of a node don't all meet the same few.
NEAR = 1e-9


class _Best:
    """The k largest values of each row above a floor, while blocks pass by."""

    def __init__(self, ids: np.ndarray, k: int, floor: float):
        self.ids, self.k, self.floor, self.held, self.waiting = ids, k, floor, 0, 0
        self.least = np.full(len(ids), floor - NEAR)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, row: np.ndarray, other: np.ndarray, value: np.ndarray, score: np.ndarray) -> None:
        mixed = (self.ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (other.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = value - NEAR * (mixed >> np.uint64(11)) / 2.0**53
        keep = (key > self.least[row]) & (value > self.floor)
        self.parts.append(tuple(x[keep] for x in (row, other, key, score)))
        self.waiting += int(keep.sum())
        if self.waiting > max(self.held, 20_000):
            self.merge()

    def merge(self) -> None:
        row, other, key, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((other, -key, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        keep, last = order[place < self.k], order[place == self.k - 1]
        self.least[row[last]] = key[last]
        self.parts, self.held, self.waiting = [(row[keep], other[keep], key[keep], score[keep])], len(keep), 0


class ScoredPairs:
    """Pairs (u, v, score) as rescore gives them for the cosine pairs of two sides (nid, emb) at a threshold."""

    def __init__(self, u: DataFrame, v: DataFrame, threshold: float, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), chunk: int = CHUNK):
        self.spark, self.threshold, self.weights = u.sparkSession, threshold, tuple(w / sum(weights) for w in weights)
        self.count = {k: max(1, -(-t.count() // chunk)) for k, t in (("u", u), ("v", v))}
        self.chunks = {k: self._packed(t, k) for k, t in (("u", u), ("v", v))}
        low, high = self._sums()
        self.scale = self._scale(low, high) if low is not None else None

    def _key(self, side: str, nid: str):
        return F.pmod(F.xxhash64(F.col(nid).cast("long")), F.lit(self.count[side]))

    def _packed(self, rows: DataFrame, side: str) -> DataFrame:
        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("nid")  # in one order in each pass, so that cosines agree to the last bit
            none = np.zeros(len(part)).tobytes()
            x = np.array(part["x"].tolist(), float)
            return pd.DataFrame({"c": [part["c"].iloc[0]], "ids": [part["nid"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "s": [none], "n": [none], "p": [none]})

        unit = rows.select(self._key(side, "nid").alias("c"), F.col("nid").cast("long").alias("nid"), normalised("emb").alias("x"))
        return stored(unit.groupBy("c").applyInPandas(pack, CHUNK_DDL))

    def _pass(self, by: str, run: Callable, ddl: str, chunks: dict[str, DataFrame] | None = None) -> DataFrame:
        """run over all pairs of chunks: a task meets one chunk of `by`, in turn, with up to MEETS of the other side."""
        chunks, other = chunks or self.chunks, "v" if by == "u" else "u"
        one = chunks[by].repartitionByRange(self.count[by], "c").toDF(*(f"{c}0" for c in chunks[by].columns))
        more = chunks[other].repartitionByRange(-(-self.count[other] // MEETS), "c").sortWithinPartitions("c").toDF(*(f"{c}1" for c in chunks[by].columns))
        with batch_rows(self.spark, 16):  # a row is two chunks
            return stored(one.crossJoin(more.hint("shuffle_replicate_nl")).mapInPandas(run, ddl))

    def _with(self, side: str, of_chunk: DataFrame, put: Callable) -> DataFrame:
        return stored(self.chunks[side].groupBy("c").cogroup(of_chunk.groupBy("c")).applyInPandas(put, CHUNK_DDL))

    def _sums(self) -> tuple[float | None, float | None]:
        """Each node's sum and number of cosines at the threshold go to its chunk; the least and the largest one are returned."""
        threshold = self.threshold

        def run(batches):
            for a, b in _met(batches):
                sums, low, high = [np.zeros((2, len(t.ids))) for t in (a, b)], np.inf, -np.inf
                for i in range(0, len(a.ids), SLAB):
                    cos = a.x[i : i + SLAB] @ b.x.T
                    has = cos >= threshold
                    low, high = min(low, cos.min(where=has, initial=np.inf)), max(high, cos.max(where=has, initial=-np.inf))
                    cos = np.where(has, cos, 0.0)
                    sums[0][:, i : i + SLAB] = cos.sum(1), has.sum(1)
                    sums[1] += cos.sum(0), has.sum(0)
                own, other = [t.c for t in (a, b)], [t.c for t in (b, a)]
                yield pd.DataFrame({"side": ["u", "v"], "c": own, "other": other, "s": [x[0].tobytes() for x in sums], "n": [x[1].tobytes() for x in sums], "low": low, "high": high})

        def put(chunk: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            for k in ("s", "n") if len(parts) else ():
                chunk[k] = [sum(np.frombuffer(x) for x in parts.sort_values("other")[k]).tobytes()]
            return chunk

        parts = self._pass("u", run, "side string, c long, other long, s binary, n binary, low double, high double")
        old, self.chunks = self.chunks, {k: self._with(k, parts.where(F.col("side") == k).select("c", "other", "s", "n"), put) for k in ("u", "v")}
        low, high = parts.where("low <= high").agg(F.min("low"), F.max("high")).first()
        drop(parts, *old.values())
        return low, high

    def _scale(self, low: float, high: float) -> list[tuple[float, float]]:
        """Of the cosine and both confidences: the least value, and the weight over the width."""
        threshold = self.threshold

        def run(batches):
            for a, b in _met(batches):
                ends = [(np.inf, -np.inf)] * 2
                for i in range(0, len(a.ids), SLAB):
                    cos = _cosines(a, b, i, threshold)
                    conf, degree = _confidences(cos, a, b, i)
                    values = conf, np.where(np.isnan(cos), np.nan, degree)
                    ends = [(min(x, np.fmin.reduce(v, None, initial=np.inf)), max(y, np.fmax.reduce(v, None, initial=-np.inf))) for v, (x, y) in zip(values, ends)]
                yield pd.DataFrame([[y for x in ends for y in x]], columns=["l1", "h1", "l2", "h2"])

        found = self._pass("u", run, "l1 double, h1 double, l2 double, h2 double")
        l1, h1, l2, h2 = found.agg(F.min("l1"), F.max("h1"), F.min("l2"), F.max("h2")).first()
        drop(found)
        return [(x, w / (y - x) if y - x > 1e-12 else 0.0) for w, x, y in zip(self.weights, (low, l1, l2), (high, h1, h2))]

    def bounds(self) -> tuple[int, int, float, float]:
        """The number of nodes of u and of v that have a pair, and bounds of the score."""
        def having(batches):
            for batch in batches:
                yield pd.DataFrame({"k": [int((np.frombuffer(x) > 0).sum()) for x in batch["n"]]})

        nu, nv = (self.chunks[k].select("n").mapInPandas(having, "k long").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] for k in ("u", "v"))
        return nu, nv, sum(max(w, 0.0) for w in self.weights), sum(min(w, 0.0) for w in self.weights)

    def best(self, by: str, k: int, prices: dict[str, DataFrame] | None = None, floor: float = -np.inf) -> DataFrame:
        """(u, v, score): of each node of a side the k pairs of the largest score or, if prices (node, price) are given, of the largest gain above a floor."""
        scale, threshold, priced = self.scale, self.threshold, prices is not None

        def run(batches):
            a, kept = None, None

            def found():
                if kept.parts:
                    kept.merge()
                    row, other, key, score = kept.parts[0]
                    yield pd.DataFrame({by: a.ids[row], "v" if by == "u" else "u": other, "value": key, "score": score})

            for now, b in _met(batches):
                if now is not a:
                    if a is not None:
                        yield from found()
                    a, kept = now, _Best(now.ids, k, floor)
                u, v = (a, b) if by == "u" else (b, a)  # one product in either case, as the last bits of another may differ
                for i in range(0, len(u.ids), SLAB):
                    cos = _cosines(u, v, i, threshold)
                    conf, degree = _confidences(cos, u, v, i)
                    score = np.zeros_like(cos)
                    for x, (low, w) in zip((cos, conf, degree), scale):
                        x -= low
                        x *= w
                        score += x
                    value = score + u.p[i : i + SLAB, None] + v.p if priced else score
                    x, y = np.nonzero(value > (kept.least[i : i + SLAB, None] if by == "u" else kept.least))
                    if len(x):
                        own, other = (x + i, v.ids[y]) if by == "u" else (y, u.ids[x + i])
                        kept.add(own, other, value[x, y], score[x, y])
            if a is not None:
                yield from found()

        def put(chunk: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
            ids = np.frombuffer(chunk["ids"].iloc[0], np.int64)
            return chunk.assign(p=[pd.Series(prices["price"].to_numpy(), prices["node"]).reindex(ids, fill_value=-np.inf).to_numpy(float).tobytes()])

        chunks = {s: self._with(s, prices[s].withColumn("c", self._key(s, "node")), put) for s in ("u", "v")} if priced else None
        rows = self._pass(by, run, f"{by} long, {'v' if by == 'u' else 'u'} long, value double, score double", chunks)
        drop(*(chunks or {}).values())
        return rows


def _cosines(u: SimpleNamespace, v: SimpleNamespace, i: int, threshold: float) -> np.ndarray:
    """Cosines of a slab of u with v; NaN below the threshold."""
    cos = u.x[i : i + SLAB] @ v.x.T
    return np.where(cos >= threshold, cos, np.nan)


def _confidences(cos: np.ndarray, u: SimpleNamespace, v: SimpleNamespace, i: int) -> tuple[np.ndarray, np.ndarray]:
    """sim_conf and degree_conf of `rescore`; the former is NaN where the cosine is."""
    n = u.n[i : i + SLAB, None] + (v.n - 2)
    others = cos * -2
    others += u.s[i : i + SLAB, None]
    others += v.s
    with np.errstate(all="ignore"):
        conf = cos * n
        conf /= others
        bare = others == 0
        if len(n) and u.n[i : i + SLAB].min() + v.n.min() <= 2:
            bare |= n <= 0
        if bare.any():
            conf[bare] = np.where(np.isnan(cos[bare]), np.nan, 1.5)
        n += 1
        return conf, np.divide(1, n, out=n)
