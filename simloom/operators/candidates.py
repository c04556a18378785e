"""Candidate pairs between two embedded graphs, and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.operators.blocking import block_keys, choose_positions
from simloom.scratch import stored


def normalised(column: str) -> Column:
    """The vector over its length, as doubles; a zero vector stays zero."""
    x = F.transform(column, lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    over = lambda s: F.transform(x, lambda v: F.when(s > 0, v / s).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(size), over), 1)  # the length is bound once, not taken again for each element


def hyperplane_bits(rows: DataFrame, columns: list[str], planes: int, seed: int, wanted: list[int]) -> DataFrame:
    """rows with bits: for each wanted plane whether the concatenated vector lies on its positive side.

    Of the `planes` Gaussian planes only the wanted ones are drawn; both sides of a join share them by
    the seed.
    """
    dims = rows.select(F.max(sum((F.size(c) for c in columns), F.lit(0)))).first()[0] or 0
    normal = {p: np.random.default_rng([seed, p]).standard_normal(dims) for p in wanted}
    if any(p >= planes for p in wanted):
        raise ValueError("a wanted plane doesn't exist")
    matrix = rows.sparkSession.sparkContext.broadcast(np.array([normal[p] for p in wanted]).reshape(len(wanted), dims))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.hstack([np.array(batch[c].tolist(), float) for c in columns])
                side = (x @ matrix.value.T >= 0).astype(int)
                yield batch.assign(bits=["".join(map(str, r)) for r in side])

    return rows.mapInPandas(run, fields + ", bits string")


def buckets(rows: DataFrame, columns: list[str], count: int, size: int, seed: int, planes: int = 1024) -> DataFrame:
    """rows, once for each pass, with pass and blk: the sides of `size` sampled planes.

    size 0 is one bucket, so that all pairs are compared.
    """
    passes = choose_positions(count, size, planes, seed)
    wanted = sorted({p for x in passes for p in x})
    if not wanted:
        return block_keys(rows, [[]], None)
    place = {p: i for i, p in enumerate(wanted)}
    keyed = hyperplane_bits(rows, columns, planes, seed, wanted)
    return block_keys(keyed, passes, lambda p: F.substring("bits", place[p] + 1, 1)).drop("bits")


def cosine_pairs(u: DataFrame, v: DataFrame, threshold: float, columns: list[str] = ("emb",), weights: list[float] | None = None, chunk: int = 4096, any_channel: bool = False) -> DataFrame:
    """(u, v, cos[, cos_k ...]) of pairs at the threshold, within equal pass and blk where both have them.

    cos is the weighted sum of the channels' cosines. any_channel keeps a pair if one channel reaches
    the threshold, which holds all pairs of any weights that are not negative and sum to 1. Sides are
    cut into chunks of about `chunk` rows of a bucket; each pair of chunks is one matrix product.
    """
    weights = list(weights or [1.0 / len(columns)] * len(columns))
    if len(weights) != len(columns) or abs(sum(weights) - 1) > 1e-9:
        raise ValueError("one weight for each channel, with a sum of 1")
    keys = ["pass", "blk"] if "pass" in u.columns else []

    def cut(rows: DataFrame, own: str, other: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        n = lambda t: t.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / chunk)).alias("k"))
        here, there = n(mine).withColumnRenamed("k", "k0"), n(theirs).withColumnRenamed("k", "k1")
        unit = rows.select(*keys, "nid", *(normalised(c).alias(f"c{i}") for i, c in enumerate(columns)))  # before rows are copied
        sized = unit.join(here, keys).join(there, keys) if keys else unit.crossJoin(here).crossJoin(there)
        slim = sized.withColumn(own, F.pmod(F.xxhash64("nid"), F.col("k0"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("k1") - 1)))
        return slim.select(*keys, "ci", "cj", "nid", *(f"c{i}" for i in range(len(columns))))

    left, right = cut(u, "ci", "cj", u, v), cut(v, "cj", "ci", v, u)
    right = right.toDF(*right.columns)  # new attributes: both sides may come from one table
    names = [f"cos_{i}" for i in range(len(columns))]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "cos": [], **{x: [] for x in names}})
        parts = [np.array(a[f"c{i}"].tolist(), float) @ np.array(b[f"c{i}"].tolist(), float).T for i in range(len(columns))]
        cos = sum(w * p for w, p in zip(weights, parts))
        i, j = np.nonzero((np.maximum.reduce(parts) if any_channel else cos) >= threshold)
        return pd.DataFrame({"u": a["nid"].to_numpy()[i], "v": b["nid"].to_numpy()[j], "cos": cos[i, j], **{x: p[i, j] for x, p in zip(names, parts)}})

    by = [*keys, "ci", "cj"]
    ddl = "u long, v long, cos double" + "".join(f", {x} double" for x in names)
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, ddl)
    return pairs.dropDuplicates(["u", "v"]) if keys else pairs


def candidate_pairs(u: DataFrame, v: DataFrame, threshold: float = 0.9, columns: list[str] = ("emb",), weights: list[float] | None = None, lsh_count: int = 1, lsh_size: int = 0, planes: int = 1024, seed: int = 7) -> DataFrame:
    """Cosine pairs within shared hyperplane buckets; lsh_size 0 compares all pairs. Each pair once."""
    columns = list(columns)
    if lsh_size:
        u, v = (buckets(x, columns, lsh_count, lsh_size, seed, planes) for x in (u, v))
    return cosine_pairs(u, v, threshold, columns, weights)


#: Sums of so many nodes of a side (24 bytes each) are broadcast at most.
BROADCAST_NODES = 500_000


def scaled(column: str, table: DataFrame) -> tuple[Column, Column]:
    return F.min(column).alias(f"{column}_low"), (F.max(column) - F.min(column)).alias(f"{column}_width")


def rescore(pairs: DataFrame, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), strict: bool = False) -> DataFrame:
    """(u, v, cos, sim_conf, degree_conf, score) from distinct pairs (u, v, cos).

    sim_conf: the cosine times the number of other pairs of either node, over their cosines' sum; 1.5
    where there is no other. degree_conf: 1 over the number of pairs of either node. The score weighs
    the three, each brought to 0..1; a constant one gives 0 or, if strict, a null score.
    """
    total = sum(weights)
    if abs(total - 1) > 1e-9:
        weights = tuple(w / total for w in weights)
    rows = pairs.select("u", "v", "cos")
    for c, n in (("u", "x"), ("v", "y")):
        sums = stored(pairs.groupBy(c).agg(F.sum("cos").alias(f"s{n}"), F.count("*").alias(f"c{n}")))
        small = sums.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        rows = rows.join(F.broadcast(sums) if small else sums, c)  # else pairs are dealt and sorted by either node
    others = F.col("sx") + F.col("sy") - 2 * F.col("cos")
    n = F.col("cx") + F.col("cy")
    conf = F.when(n <= 2, F.lit(1.5)).otherwise(F.coalesce(F.try_divide(F.col("cos") * (n - 2), others), F.lit(1.5)))
    rows = rows.select("u", "v", "cos", conf.alias("sim_conf"), (1 / (n - 1)).alias("degree_conf"))
    names = ["cos", "sim_conf", "degree_conf"]
    stats = rows.agg(*(x for c in names for x in scaled(c, rows)))
    part = lambda c: F.try_divide(F.col(c) - F.col(f"{c}_low"), F.when(F.col(f"{c}_width") > 1e-12, F.col(f"{c}_width")))
    parts = [part(c) if strict else F.coalesce(part(c), F.lit(0.0)) for c in names]
    score = sum((F.lit(float(w)) * p for w, p in zip(weights, parts)), F.lit(0.0))
    return rows.crossJoin(F.broadcast(stats)).select("u", "v", *names, score.alias("score"))
