"""Similarity graphs as edge tables (src, dst, weight), src < dst, each pair once. Nodes without edges don't exist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.scratch import drop, stored


def create_graph(edges: DataFrame, min_comp_size: int = 3) -> DataFrame:
    """Each pair once, and only components of at least `min_comp_size` nodes."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").dropDuplicates(["src", "dst"])
    return filter_components(once, min_comp_size)


def symmetric(edges: DataFrame) -> DataFrame:
    """(v, n, weight): each edge from both of its ends."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("n"), "weight").unionAll(edges.select(F.col("dst").alias("v"), F.col("src").alias("n"), "weight"))


def marks(edges: DataFrame) -> tuple:
    """The number of distinct edges (x, y) and two sums of their hashes, by which tables are compared without a join."""
    return tuple(edges.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(k), "x", "y").cast("decimal(38,0)")) for k in (1, 2))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(nid, comp): the smallest node of each node's component.

    Alternating star contraction: in turn each node links its larger neighbours, then its smaller ones,
    to the smallest of all, until only stars are left; a logarithmic number of rounds in practice. Tables
    of past rounds are deleted.
    """
    rows = stored(edges.select(F.greatest("src", "dst").alias("x"), F.least("src", "dst").alias("y")).distinct())
    mark = marks(rows)
    for _ in range(max_rounds):
        both = rows.unionAll(rows.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("of"), F.least("x", "m").alias("m"))
        large = stored(both.where("y > x").join(least, F.col("x") == F.col("of")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "of")
        met = large.join(least, F.col("x") == F.col("of"))
        new = stored(met.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionAll(met.select("x", F.col("m").alias("y"))).distinct())
        before, mark = mark, marks(new)
        drop(rows, large)
        rows = new
        if mark == before:
            return rows.select(F.col("x").alias("nid"), F.col("y").alias("comp")).unionAll(rows.select(F.col("y").alias("nid"), F.col("y").alias("comp")).distinct())
    raise RuntimeError("components didn't settle")


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.join(comps.groupBy("comp").agg(F.count("*").alias("comp_size")), "comp")


def filter_components(edges: DataFrame, min_size: int) -> DataFrame:
    """The edges of components of at least min_size nodes; 0 to 2 keep all, as an edge has two nodes."""
    if min_size <= 2:
        return edges
    comps = component_sizes(components(edges)).where(F.col("comp_size") >= min_size).select(F.col("nid").alias("src"))
    return edges.join(comps, "src", "left_semi").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("v").agg(F.count("*").alias("deg")).withColumnRenamed("v", "nid")


def weight_stats(edges: DataFrame) -> DataFrame:
    """(nid, deg, wmax, wmin, wavg, wstd): over a node's edges; the deviation is of the population."""
    return symmetric(edges).groupBy(F.col("v").alias("nid")).agg(
        F.count("*").alias("deg"), F.max("weight").alias("wmax"), F.min("weight").alias("wmin"), F.avg("weight").alias("wavg"), F.stddev_pop("weight").alias("wstd")
    )


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(nid, degcentr): the degree over the number of other nodes of the component."""
    sized = component_sizes(components(edges))
    return degrees(edges).join(sized, "nid").select("nid", (F.col("deg") / (F.col("comp_size") - 1)).alias("degcentr"))


def triangles(edges: DataFrame) -> DataFrame:
    """(nid, triangles). Edges point to the end of larger degree, so no node has many wedges."""
    deg = degrees(edges)
    ends = edges.select("src", "dst").join(deg.select(F.col("nid").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("nid").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = out.join(out.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(closed, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("nid")).groupBy("nid").agg(F.count("*").alias("triangles"))


def egonets(edges: DataFrame) -> DataFrame:
    """(nid, ego_edges, ego_dens): edges among a node and its neighbours, and their share of all pairs."""
    rows = degrees(edges).join(triangles(edges), "nid", "left").withColumn("ego_edges", F.col("deg") + F.coalesce("triangles", F.lit(0)))
    n = F.col("deg") + 1
    return rows.select("nid", "ego_edges", (F.col("ego_edges") / (n / 2 * (n - 1))).alias("ego_dens"))


def bin_count(max_degree: int) -> int:
    """Bins of a histogram of degrees up to max_degree: one for each power of two that can occur."""
    return max(1, max_degree.bit_length())


def _histogram(members: DataFrame, edges: DataFrame, bins: int, name: str) -> DataFrame:
    """members (nid, n): counts of the members' degrees by the whole part of their logarithm to base 2."""
    binned = degrees(edges).select(F.col("nid").alias("n"), (F.length(F.bin("deg")) - 1).alias("bin"))
    counts = [F.count(F.when(F.col("bin") == b, 1)).cast("double") for b in range(bins)]
    return members.join(binned, "n").groupBy("nid").agg(F.array(*counts).alias(name))


def one_hop(edges: DataFrame) -> DataFrame:
    """(nid, n): the node itself and its neighbours."""
    both = symmetric(edges).select(F.col("v").alias("nid"), "n")
    return both.unionAll(both.select("nid", F.col("nid").alias("n")).distinct())


def one_hop_histogram(edges: DataFrame, bins: int) -> DataFrame:
    return _histogram(one_hop(edges), edges, bins, "h1")


def two_hop_histogram(edges: DataFrame, bins: int) -> DataFrame:
    near = one_hop(edges)
    far = near.join(near.select(F.col("nid").alias("n"), F.col("n").alias("m")), "n").select("nid", F.col("m").alias("n")).distinct()
    return _histogram(far, edges, bins, "h2")


def betweenness(edges: DataFrame, most_edges: int = 20_000_000) -> DataFrame:
    """(nid, betw): exact unweighted betweenness over (n - 1)(n - 2) / 2, n counting all nodes.

    One breadth-first search for each source (Brandes). The adjacency, two integers an edge, is
    broadcast behind a check: work grows as nodes times edges, so a graph beyond `most_edges` is out
    of reach of an exact count and is refused, not sampled.
    """
    spark = edges.sparkSession
    m = edges.count()
    if m > most_edges:
        raise ValueError(f"{m} edges are too many for exact betweenness; filter components or use another feature set")
    pairs = edges.select("src", "dst").toPandas().to_numpy(np.int64)
    names, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    n = len(names)
    a, b = np.concatenate([flat[:, 0], flat[:, 1]]), np.concatenate([flat[:, 1], flat[:, 0]])
    order = np.argsort(a, kind="stable")
    held = spark.sparkContext.broadcast((np.searchsorted(a[order], np.arange(n + 1)), b[order], names))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, ends, names = held.value
        n = len(names)
        total = np.zeros(n)
        for batch in batches:
            for s in batch["i"]:
                depth, paths = np.full(n, -1), np.zeros(n)
                depth[s], paths[s] = 0, 1
                front, levels = np.array([s]), []
                while len(front):  # level by level; each is a pair of arrays of arcs
                    size = starts[front + 1] - starts[front]
                    at = np.repeat(starts[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    x, y = np.repeat(front, size), ends[at]
                    depth[y[depth[y] < 0]] = len(levels) + 1
                    down = depth[y] == len(levels) + 1
                    x, y = x[down], y[down]
                    np.add.at(paths, y, paths[x])
                    levels.append((x, y))
                    front = np.unique(y)
                credit = np.zeros(n)
                for x, y in reversed(levels):
                    np.add.at(credit, x, paths[x] / paths[y] * (1 + credit[y]))
                credit[s] = 0
                total += credit
        yield pd.DataFrame({"nid": names, "part": total})

    scale = (n - 1) * (n - 2)  # each pair of ends is counted from both, hence no half
    sources = spark.range(n).withColumnRenamed("id", "i").repartition(min(max(1, n // 16), 4 * spark.sparkContext.defaultParallelism))
    sums = sources.mapInPandas(partial, "nid long, part double").groupBy("nid").agg(F.sum("part").alias("part"))
    return sums.select("nid", (F.col("part") / F.lit(float(scale)) if scale > 0 else F.lit(0.0)).alias("betw"))


FEATURE_SETS = ("fast", "egonet1", "egonet2", "all")


def node_features(edges: DataFrame, nodes: DataFrame, feature_set: str = "all", max_degree: int | None = None, node_count: bool = False) -> DataFrame:
    """(nid, features): the feature vector of each node that has edges; nodes gives qgrams_count and node_count.

    max_degree: the largest degree to make bins for, by default one less than the number of nodes.
    Costly parts are planned only if the set has them.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"a feature set is one of {', '.join(FEATURE_SETS)}")
    rows = weight_stats(edges).join(nodes.select("nid", "qgrams_count", "node_count"), "nid", "left").join(degree_centrality(edges), "nid")
    columns = ["qgrams_count", "deg", "wmax", "wmin", "wavg", "wstd"]
    tail = []
    if feature_set != "fast":
        bins = bin_count(max_degree if max_degree is not None else max(1, nodes.count() - 1))
        rows = rows.join(egonets(edges), "nid").join(one_hop_histogram(edges, bins), "nid")
        columns += ["ego_edges", "ego_dens"]
        tail = ["h1"]
    if feature_set in ("egonet2", "all"):
        rows = rows.join(two_hop_histogram(edges, bins), "nid")
        tail = ["h1", "h2"]
    if feature_set == "all":
        rows = rows.join(betweenness(edges), "nid")
        columns.append("betw")
    columns.append("degcentr")
    vector = [F.array(*(F.col(c).cast("double") for c in columns)), *(F.col(c) for c in tail)]
    if node_count:
        vector.append(F.array(F.col("node_count").cast("double")))
    return rows.select("nid", F.concat(*vector).alias("features"))
