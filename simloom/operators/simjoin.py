"""Similarity self-joins: (src, dst, weight) for pairs of nodes at or above a threshold, src < dst."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.functions import bloom
from simloom.functions.estimators import adjusted_dice, dice

#: Relative slack of candidate tests before the exact one.
_SLACK = 1e-9


def _share(threshold: float) -> float:
    """Dice >= t needs a smaller side of at least this share of the larger one, and as large an overlap."""
    return threshold / (2 - threshold)


def _grid(rows: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """Two copies of rows whose equi-join on (ci, cj) meets each pair in one cell of a square of cells."""
    own = F.pmod(F.xxhash64("nid"), F.lit(cells))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    return rows.withColumn("ci", own).withColumn("cj", every), rows.withColumn("cj", own).withColumn("ci", every)


def _named(rows: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return rows.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns))


def plain_edges(nodes: DataFrame, threshold: float, blocks: DataFrame | None = None) -> DataFrame:
    """Dice over bigram sets. nodes has nid and grams; blocks (nid, pass, blk) limits the pairs.

    Without blocks, an inverted index over each set's rarest bigrams finds candidates: a pair at the
    threshold shares one of its first n - ceil(share * n) + 1, as its overlap is at least that
    share of either. A pair is met in its rarest common prefix bigram alone, so nothing has to be
    made distinct. Threshold 0 keeps all pairs, by a grid of cells.
    """
    rows = nodes.select("nid", "grams").withColumn("n", F.size("grams"))
    if blocks is not None:
        keyed = blocks.select("nid", "pass", "blk").join(rows, "nid")
        both = _named(keyed, "a_", ["pass", "blk"]).join(_named(keyed, "b_", ["pass", "blk"]), ["pass", "blk"]).where("a_nid < b_nid")
        return _pairs(both, threshold).dropDuplicates(["src", "dst"])
    if threshold <= 0:
        a, b = _grid(rows, max(1, math.ceil(rows.count() / 2000)))
        both = _named(a, "a_", ["ci", "cj"]).join(_named(b, "b_", ["ci", "cj"]), ["ci", "cj"]).where("a_nid < b_nid")
        return _pairs(both, threshold)
    share = _share(threshold)
    # one number a bigram, rare ones small: a sorted set has its rarest bigrams in front. There are as
    # many as pairs of letters in use, however many nodes there are, so one task numbers them.
    long = rows.select("nid", F.explode("grams").alias("gram"))
    rank = long.groupBy("gram").agg(F.count("*").alias("f")).select("gram", F.row_number().over(W.orderBy("f", "gram")).alias("token"))
    sets = long.join(rank, "gram").groupBy("nid").agg(F.array_sort(F.collect_list("token")).alias("grams")).withColumn("n", F.size("grams"))
    front = F.slice("grams", 1, (F.col("n") - F.ceil(F.col("n") * share - _SLACK) + 1).cast("int"))
    index = sets.select("nid", "n", "grams", F.explode(front).alias("token"))
    both = _named(index, "a_", ["token"]).join(_named(index, "b_", ["token"]), "token")
    fits = (F.col("a_nid") < F.col("b_nid")) & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * share - _SLACK)
    # common bigrams stand in order: the first is the rarest, and lies in front of both sets of a pair at the threshold
    met = both.where(fits).withColumn("common", F.array_intersect("a_grams", "b_grams")).where(F.get("common", F.lit(0)) == F.col("token"))
    weight = (2.0 * F.size("common") / (F.col("a_n") + F.col("b_n"))).alias("weight")
    return met.select(F.col("a_nid").alias("src"), F.col("b_nid").alias("dst"), weight).where(F.col("weight") >= threshold)


def _pairs(both: DataFrame, threshold: float) -> DataFrame:
    out = both.select(F.col("a_nid").alias("src"), F.col("b_nid").alias("dst"), dice(F.col("a_grams"), F.col("b_grams")).alias("weight"))
    return out.where(F.col("weight") >= threshold)


def encoded_edges(nodes: DataFrame, threshold: float, length: int = 1024, hashes: int = 10, blocks: DataFrame | None = None, cell: int = 2000) -> DataFrame:
    """Adjusted dice over Bloom filters. nodes has nid, bits and the word columns.

    A pair is at the threshold t > 0 if the union has at most l (1 - y_a y_b) bits, y being
    (1 - b/l)^(1 - t/2): no logarithm is taken for a pair before this test passes. Counts may differ
    by a factor of (2 - t)/t at most, so nodes are put into bands of that width by the logarithm of
    their count and only meet their own and the next band. Within bands a grid of cells bounds what
    one task holds. Saturated filters are similar to nothing.
    """
    names = bloom.word_names(length)
    rows = nodes.select("nid", "bits", *names).where(F.col("bits") < length)
    rows = rows.withColumn("y", F.pow(1 - F.col("bits") / F.lit(float(length)), F.lit(1 - threshold / 2)))
    if blocks is not None:
        keyed = blocks.select("nid", "pass", "blk").join(rows, "nid")
        both = _named(keyed, "a_", ["pass", "blk"]).join(_named(keyed, "b_", ["pass", "blk"]), ["pass", "blk"]).where("a_nid < b_nid")
        return _close(both, threshold, length, hashes).dropDuplicates(["src", "dst"])
    banded = threshold > 0
    if banded:
        rows = rows.where("bits > 0")
        width = math.log(1 / _share(threshold)) if threshold < 1 else 1.0
        band = F.floor(F.log(-F.log(1 - F.col("bits") / F.lit(float(length)))) / F.lit(max(width, 1e-6)) - F.lit(_SLACK))
    else:
        band = F.lit(0).cast("long")
    rows = rows.withColumn("band", band)
    a, b = _grid(rows, max(1, math.ceil(rows.count() / cell)))
    a = _named(a.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1) if banded else F.array("band"))), "a_", ["at", "ci", "cj"])
    b = _named(b.withColumn("at", F.col("band")), "b_", ["at", "ci", "cj"])
    both = a.join(b, ["at", "ci", "cj"]).where((F.col("a_band") < F.col("b_band")) | (F.col("a_nid") < F.col("b_nid")))
    return _close(both, threshold, length, hashes)


def _close(both: DataFrame, threshold: float, length: int, hashes: int) -> DataFrame:
    names = bloom.word_names(length)
    side = lambda p: [F.col(f"{p}{w}") for w in names]
    rows = both.withColumn("union", bloom.union_popcount(side("a_"), side("b_")))
    if threshold > 0:
        rows = rows.where(F.col("union") <= length * (1 - F.col("a_y") * F.col("b_y")) + 1e-6)
    weight: Column = adjusted_dice(F.col("a_bits"), F.col("b_bits"), F.col("union"), length, hashes)
    out = rows.select(F.least("a_nid", "b_nid").alias("src"), F.greatest("a_nid", "b_nid").alias("dst"), weight.alias("weight"))
    return out.where(F.col("weight") >= threshold)
