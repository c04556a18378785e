"""Precision of ranked matches against the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_K = (10, 50, 100, 500, 1000)


def class_truth(matches: DataFrame, u_classes: DataFrame, v_classes: DataFrame) -> DataFrame:
    """(u_key, v_key) of the matches whose nodes are of one class, from (u_key, class) and (v_key, class).

    A truth by classes is not listed as pairs, of which a class of n nodes on either side has n squared.
    """
    u, v = u_classes.withColumnRenamed("class", "u_class"), v_classes.withColumnRenamed("class", "v_class")
    rows = matches.select("u_key", "v_key").distinct().join(u, "u_key").join(v, "v_key")
    return rows.where("u_class = v_class").select("u_key", "v_key").distinct()


def flagged(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """matches (rank, u_key, v_key, ...) with is_true."""
    known = truth.select("u_key", "v_key").distinct().withColumn("is_true", F.lit(True))
    return matches.join(known, ["u_key", "v_key"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def true_matches(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, the number of matches in the truth; null if there is no match."""
    return flagged(matches, truth).agg(F.sum(F.col("is_true").cast("long")).alias("tp"))


def precision_at(matches: DataFrame, truth: DataFrame, ks: tuple[int, ...] = DEFAULT_K) -> DataFrame:
    """(k, tp, precision): true ones of the first k over k, however few there are; NaN without matches."""
    rows = flagged(matches, truth)
    hits = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.when((F.col("rank") <= k) & F.col("is_true"), 1)), F.lit(0)).alias(f"k{k}") for k in ks))
    long = hits.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("tp")) for k in ks))).alias("r"))
    return long.select("r.k", "r.tp", F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("r.tp") / F.col("r.k")).alias("precision"))
