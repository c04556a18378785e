"""Result tables, appended to run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the result files' columns.

#: Columns of older result files under their present names.
RENAMED = {"lsh_count": "lsh_count_nm", "lsh_size": "lsh_size_nm"}

#: What each technique adds to the common columns.
TECHNIQUE_COLUMNS = {
    "features": [],
    "graphwave": ["type", "weight", "scales", "sample_points_linspace", "order_approx"],
    "graphsage": ["weight", "layers", "num_samples", "number_of_walks", "length", "batch_size", "epochs"],
    "deepgraphinfomax": ["weight", "layers", "activation", "epochs"],
}
COMMON = ["file", "dataset", "record_count", "threshold", "removed_records_plain", "removed_records_encoded", "node_features"]
PARAMETERS = ["no_matches", "graph_matching_tech", "lsh_count_nm", "lsh_size_nm", "cos_sim_threshold", "hyperplane_count", "min_comp_size", "scaler", "vidanage_weights", "lsh_count_blk", "lsh_size_blk"]


def result_row(precision: DataFrame, values: dict, technique: str) -> DataFrame:
    """One row: common columns, a column for each k of precision (k, tp, precision), parameters, the technique's."""
    if technique not in TECHNIQUE_COLUMNS:
        raise ValueError(f"a technique is one of {', '.join(TECHNIQUE_COLUMNS)}")
    wide = precision.agg(*(F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"precision_{k}") for k in sorted(values["ks"])))
    text = lambda c: F.lit(None if values.get(c) is None else str(values[c])).cast("string").alias(c)
    return wide.select(*map(text, COMMON), *(f"precision_{k}" for k in values["ks"]), *map(text, PARAMETERS), *map(text, TECHNIQUE_COLUMNS[technique]))


def append(row: DataFrame, folder: str, name: str, form: str = "parquet") -> None:
    """Add rows to a result table, Parquet or CSV with a header."""
    writer = row.coalesce(1).write.mode("append")
    path = f"{folder.rstrip('/')}/{name}"
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def read_results(spark: SparkSession, folder: str, name: str, form: str = "parquet") -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    rows = spark.read.option("header", True).csv(path) if form == "csv" else spark.read.option("mergeSchema", True).parquet(path)
    for old, new in RENAMED.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows


def append_timing(spark: SparkSession, folder: str, record_count: int, threshold: float, feature_set: str, seconds: float) -> None:
    row = spark.createDataFrame([(record_count, threshold, feature_set, seconds)], "record_count long, threshold double, feature_set string, time double")
    append(row, folder, "performance/nf")
