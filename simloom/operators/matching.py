"""One-to-one matching of candidate pairs (u, v, score). Ties: the larger score, then the smaller u, then v."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.operators.graph import components
from simloom.operators.scoredpairs import ScoredPairs
from simloom.scratch import drop, scratch_folder, stored


def _order():
    return F.col("rounded").desc(), F.col("u"), F.col("v")


def _ranked(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("score").isNotNull()).withColumn("rounded", F.round("score", 12))


def _mutual(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of either node: those that both tables of best pairs, by u and by v, hold."""
    whole, order = F.struct(*pairs.columns), F.struct("rounded", -F.col("u"), -F.col("v"))
    best_u, best_v = (pairs.groupBy(F.col(c).alias("of")).agg(F.max_by(whole, order).alias("best")).select("best.*") for c in ("u", "v"))
    return best_u.join(best_v.select("u", "v"), ["u", "v"]).select(*pairs.columns)


def shm(pairs: DataFrame, k: int = 1000) -> DataFrame:
    """Symmetric highest match: pairs that are best for both of their nodes."""
    return _top(_mutual(_ranked(pairs.select("u", "v", "score"))), k)


def smm(pairs: DataFrame, k: int = 1000) -> DataFrame:
    """Stable marriage. Both sides rank by one order, so it is unique: mutual best, then again among the rest.

    The best pair of all is always mutual, so each round matches some, and the rounds end however many
    there are. What is left is a table of each round; the matches of all are appended to one.
    """
    left, path = stored(_ranked(pairs)), scratch_folder(pairs.sparkSession)
    while True:
        if left.isEmpty():
            left.write.mode("append").parquet(path)  # there is a table, then, without any pair too
            return _top(pairs.sparkSession.read.schema(left.schema).parquet(path), k)
        now = stored(_mutual(left))
        now.write.mode("append").parquet(path)
        rest = stored(left.join(now.select("u"), "u", "left_anti").join(now.select("v"), "v", "left_anti"))
        drop(left, now)
        left = rest


def cover(n: int, m: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray, alone: float, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mate, a, b): the largest total weight in which each of n rows has a column of its own or, at a loss of `alone`, none.

    Rows and columns meet in the given cells (i, j) only. mate is -1 for a row without a column. a and b
    prove the optimum: weight <= -(a[i] + b[j]) in every cell, where b is 0 for columns without a row and
    negative or 0 for others. Shortest augmenting paths, with memory in proportion to the cells.
    known: the same three for some of the cells; then only rows that gain by the others are searched anew.
    """
    order = np.lexsort((j, i))
    cols, cost, start = j[order], -weight[order], np.searchsorted(i[order], np.arange(n + 1))
    mate, a, b = (x.copy() for x in known) if known else (np.full(n, -1), np.full(n, float(alone)), np.zeros(m))
    near = 4 * float(np.spacing(alone)) if known else 0.0  # what sums of prices are off by
    least = np.full(n, float(alone))
    np.minimum.at(least, i[order], cost - b[cols])
    gains = least < a - near
    a[gains], mate[gains] = least[gains], -1
    holder = np.full(m, -1)
    holder[mate[mate >= 0]] = np.flatnonzero(mate >= 0)
    for row in np.flatnonzero(gains):  # a row's best column, where that is free
        own = slice(start[row], start[row + 1])
        if holder[col := cols[own][np.argmin(cost[own] - b[cols[own]])]] < 0:
            mate[row], holder[col] = col, row
    dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
    for first in np.flatnonzero((mate < 0) & (a < alone - near)):
        row, delta, heap, path, seen, end, free, last = first, 0.0, [], [], [], np.inf, np.inf, first
        while True:
            if (lone := delta + alone - a[row]) < end:
                end, last = lone, row
            own = slice(start[row], start[row + 1])
            at = cols[own]
            new = delta + cost[own] - a[row] - b[at]
            better = (new < dist[at]) & (new < min(end, free)) & ~done[at]
            at, new = at[better], new[better]
            free = min(free, new[holder[at] < 0].min(initial=np.inf))  # the search ends there: what is farther isn't needed
            at, new = at[new <= free], new[new <= free]
            dist[at], back[at] = new, row
            seen.append(at)
            for x in zip(new.tolist(), at.tolist()):
                heapq.heappush(heap, x)
            while heap and done[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                delta, col = end, -1
                break
            delta, col = heapq.heappop(heap)
            done[col] = True
            if holder[col] < 0:
                break
            path.append(col)
            row = holder[col]
        a[first] += delta
        if path:
            a[holder[path]] += delta - dist[path]
            b[path] += dist[path] - delta
        if col < 0:
            col, mate[last] = mate[last], -1
        while col >= 0:
            row = back[col]
            holder[col], mate[row], col = row, col, mate[row]
        for at in seen:
            dist[at], back[at], done[at] = np.inf, -1, False
    if ((holder < 0) & (b < 0)).any():
        _free_columns(mate, holder, a, b, i[order], cols, cost)
    return mate, a, b


def _free_columns(mate: np.ndarray, holder: np.ndarray, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> None:
    """Raise the prices b of columns without a row to 0, and give them to rows that gain by it; `cover` from the columns' end."""
    order = np.lexsort((i, j))
    rows, cost, start = i[order], cost[order], np.searchsorted(j[order], np.arange(len(b) + 1))
    dist, came, done = np.full(len(a), np.inf), np.full(len(a), -1), np.zeros(len(a), bool)
    for first in np.flatnonzero((holder < 0) & (b < 0)):
        col, delta, heap, path, seen, end, last = first, 0.0, [], [], [], -b[first], first
        while True:
            own = slice(start[col], start[col + 1])
            at = rows[own]
            new = delta + cost[own] - a[at] - b[col]
            better = (new < dist[at]) & (new < end) & ~done[at]
            at, new = at[better], new[better]
            dist[at], came[at] = new, col
            seen.append(at)
            for x in zip(new.tolist(), at.tolist()):
                heapq.heappush(heap, x)
            while heap and done[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                delta, row = end, -1
                break
            delta, row = heapq.heappop(heap)
            done[row] = True
            if mate[row] < 0:
                break
            path.append(row)
            col = mate[row]
            if delta - b[col] < end:
                end, last = delta - b[col], col
        b[first] += delta
        if path:
            a[path] -= delta - dist[path]
            b[mate[path]] += delta - dist[path]
        if row < 0:
            row, holder[last], b[last] = holder[last], -1, 0.0
        while row >= 0:
            col = came[row]
            mate[row], holder[col], row = col, row, holder[col]
        for at in seen:
            dist[at], came[at], done[at] = np.inf, -1, False


def loss_of_none(nodes: int, width: float) -> float:
    """More than any change of a whole matching's weight can make up for, where weights differ by `width` at most."""
    return 2.0 * (nodes + 1) * (width + 1)


def assign(weight: np.ndarray) -> list[int]:
    """The column of each row in a largest total weight assignment (-inf: no edge). Raises if none covers all rows."""
    i, j = np.nonzero(np.isfinite(weight))
    w = weight[i, j]
    mate = cover(*weight.shape, i, j, w, np.abs(w).max(initial=0) + loss_of_none(len(weight), np.ptp(w) if len(w) else 0))[0]
    if (mate < 0).any():
        raise ValueError("no assignment covers all rows")
    return mate.tolist()


#: Pairs of a node that a round of `mwm` takes up at most.
PAIRS_A_ROUND = 40


def _best(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n best pairs of each node; by a hash among equal ones, so that copies of a node don't all meet the same few."""
    order = W.partitionBy(by).orderBy(F.col(value).desc(), F.xxhash64("u", "v"), "u", "v")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("u", "v", "score")


class _Listed:
    """A table of pairs (u, v, score), as ScoredPairs says it of pairs that no table holds."""

    def __init__(self, pairs: DataFrame):
        self.spark, self.rows = pairs.sparkSession, stored(_ranked(pairs).select("u", "v", "score"))

    def bounds(self) -> tuple[int, int, float, float]:
        nu, nv, most, least = self.rows.agg(F.countDistinct("u"), F.countDistinct("v"), F.max("score"), F.min("score")).first()
        return nu, nv, most or 0.0, least or 0.0

    def best(self, by: str, k: int, prices: dict[str, DataFrame] | None = None, floor: float = -np.inf) -> DataFrame:
        value, rows = F.round("score", 12), self.rows
        for c, table in (prices or {}).items():
            rows, value = rows.join(table.toDF(c, f"price_{c}"), c), value + F.col(f"price_{c}")
        return rows.withColumn("value", value).where(F.col("value") > floor)


def _joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (nid, comp) after more edges between their nodes: those of a graph that has a node for each."""
    ends = edges.join(comps.toDF("src", "x"), "src").join(comps.toDF("dst", "y"), "dst")
    links = stored(ends.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct())
    if links.isEmpty():
        return comps
    names = components(links).toDF("comp", "name")
    return stored(comps.join(names, "comp", "left").select("nid", F.coalesce("name", "comp").alias("comp")))


def mwm(pairs: DataFrame | ScoredPairs, k: int = 1000, a_round: int = PAIRS_A_ROUND) -> DataFrame:
    """The matching of largest total score that covers the whole smaller side; empty if there is none.

    A core, first the best `a_round` pairs of each node, is solved, a component in a task. Its prices
    (`cover`) then are held against all pairs: those that could raise the total, up to `a_round` of a
    node, join the core for the next round, which starts from the matching and prices so far. If there is none, the core's matching is the best of all pairs.
    """
    rows = pairs if isinstance(pairs, ScoredPairs) else _Listed(pairs)
    nu, nv, most, least = rows.bounds()
    if not nu:
        return _top(_ranked(rows.spark.createDataFrame([], "u long, v long, score double")), k)
    a, b = ("u", "v") if nu <= nv else ("v", "u")
    alone = max(abs(most), abs(least)) + loss_of_none(min(nu, nv), most - least)
    slack = 1e-10 + 8 * float(np.spacing(alone))

    def solve(part: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        x, i = np.unique(part[a], return_inverse=True)
        y, j = np.unique(part[b], return_inverse=True)
        known = None
        if len(last):
            rows, cols = (last[last["first"] == c].set_index("node").reindex(z) for c, z in ((True, x), (False, y)))
            held = rows["mate"].notna().to_numpy()
            known = np.full(len(x), -1), rows["price"].to_numpy(float), cols["price"].to_numpy(float)
            known[0][held] = np.searchsorted(y, rows["mate"].to_numpy()[held].astype(np.int64))
        mate, at, bt = cover(len(x), len(y), i, j, part["rounded"].to_numpy(), alone, known)
        rows = pd.DataFrame({"node": x, "first": True, "price": at, "mate": pd.array(y[mate], "Int64")})
        rows.loc[mate < 0, "mate"] = pd.NA
        return pd.concat([rows, pd.DataFrame({"node": y, "first": False, "price": bt, "mate": pd.array([pd.NA] * len(y), "Int64")})])

    found = {c: rows.best(c, a_round) for c in ("u", "v")}
    core = stored(reduce(DataFrame.unionByName, (_best(t, c, "value", a_round) for c, t in found.items())).dropDuplicates(["u", "v"]))
    drop(*found.values())
    ends = F.col("u") * 2, F.col("v") * 2 + 1
    comps = components(core.select(ends[0].alias("src"), ends[1].alias("dst")))
    solved = rows.spark.createDataFrame([], "node long, first boolean, price double, mate long")
    while True:
        keyed = _ranked(core).withColumn("nid", ends[0]).join(comps, "nid").select("comp", "u", "v", "rounded")
        nid = ends[0] if a == "u" else ends[1], ends[1] if a == "u" else ends[0]
        known = solved.withColumn("u", F.col("node")).withColumn("v", F.col("node")).withColumn("nid", F.when(F.col("first"), nid[0]).otherwise(nid[1]))
        known = known.join(comps, "nid").select("comp", *solved.columns).toDF("comp", *solved.columns)  # new attributes: both have comps
        before, solved = solved, stored(keyed.groupBy("comp").cogroup(known.groupBy("comp")).applyInPandas(solve, solved.schema))
        drop(before)
        better = rows.best(a, a_round, {c: solved.where(F.col("first") == (c == a)).select("node", "price") for c in ("u", "v")}, slack)
        more = stored(_best(better, a, "value", a_round))
        drop(better)
        if more.isEmpty():
            break
        grown = stored(core.unionByName(more).dropDuplicates(["u", "v"]))
        comps = _joined(comps, more.select(ends[0].alias("src"), ends[1].alias("dst")))
        drop(core, more)
        core = grown
    drop(more)
    if not solved.where(F.col("first") & F.col("mate").isNull()).isEmpty():
        return _top(_ranked(core.where(F.lit(False))), k)
    return _top(_ranked(core.join(solved.where("first").select(F.col("node").alias(a), F.col("mate").alias(b)), ["u", "v"])), k)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(rank, u, v, score) of the k best pairs; k is what a report asks for."""
    best = pairs.orderBy(*_order()).limit(k)
    return best.select(F.row_number().over(W.orderBy(*_order())).alias("rank"), "u", "v", "score")


MATCHERS = {"shm": shm, "smm": smm, "mwm": mwm}


def match(pairs: DataFrame, technique: str = "shm", k: int = 1000) -> DataFrame:
    if technique not in MATCHERS:
        raise ValueError(f"a matching technique is one of {', '.join(MATCHERS)}")
    return MATCHERS[technique](pairs, k)
