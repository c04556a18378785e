"""Column scaling of vectors: population deviation, and 0 for constant columns, unlike Spark ML's scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale(vectors: DataFrame, kind: str, column: str = "features") -> DataFrame:
    """vectors with the column scaled dimension by dimension: "standard", "minmax" or "" for none.

    The statistics of all dimensions are one row of two arrays, a few numbers for each dimension.
    """
    if not kind:
        return vectors
    if kind not in ("standard", "minmax"):
        raise ValueError("a scaler is standard or minmax")
    long = vectors.select(F.posexplode(column).alias("d", "x"))
    low, width = (F.avg("x"), F.stddev_pop("x")) if kind == "standard" else (F.min("x"), F.max("x") - F.min("x"))
    per = long.groupBy("d").agg(low.alias("low"), width.alias("width"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "low", "width")))
    stats = per.agg(F.transform(ordered, lambda s: s["low"]).alias("_low"), F.transform(ordered, lambda s: s["width"]).alias("_width"))
    scaled = F.transform(
        F.arrays_zip(F.col(column).alias("x"), F.col("_low").alias("low"), F.col("_width").alias("width")),
        lambda z: F.when(F.abs(z["width"]) > 1e-12, (z["x"] - z["low"]) / z["width"]).otherwise(F.lit(0.0)),
    )
    return vectors.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("_low", "_width")
