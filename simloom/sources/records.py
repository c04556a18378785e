"""Record tables: CSV scan with row positions, head, tail and exact samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV with a header, all columns as text, empty fields as "", and row_idx, the position in the file.

    Positions come from the offset of each file split: the splits' row counts, a row for each split,
    are summed on the driver, so no rows are moved or sorted. A file with line breaks in quoted fields
    can't be split; it is found by a pass over the lines (unless multi_line says) and read whole.
    """
    if multi_line is None:
        # a quoted line break leaves lines with an odd number of quotes
        multi_line = not spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="\x00", emptyValue="", multiLine=multi_line, quote='"', escape='"').na.fill("")
    columns = columns or rows.columns
    split = F.col("_metadata")
    rows = rows.select(*columns, split.getField("file_path").alias("_f"), split.getField("file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    parts = sorted(map(tuple, rows.groupBy("_f", "_b").agg(F.min("_m"), F.count("*")).collect()))
    offsets, total = [], 0
    for name, start, first, n in parts:
        offsets.append((name, start, total - first))
        total += n
    table = spark.createDataFrame(offsets, "_f string, _b long, _o long")
    return rows.join(F.broadcast(table), ["_f", "_b"]).select(*columns, (F.col("_m") + F.col("_o")).alias("row_idx"))


def restrict(records: DataFrame, n: int, id_col: str = "row_idx") -> DataFrame:
    """The first n rows, the last -n rows if n is negative, all if n is 0; by position, not by limit()."""
    if not n:
        return records
    if n > 0:
        return records.where(F.col(id_col) < n)
    last = records.agg(F.max(id_col)).first()[0]
    return records.where(F.col(id_col) > (last if last is not None else 0) + n)


def sample_exact(records: DataFrame, removed: float, seed: int, id_col: str = "row_idx") -> DataFrame:
    """round((1 - removed) * N) rows without replacement, the same for a seed whatever the partitioning.

    The rows of smallest md5 of "seed:id". A histogram of the hashes' first 16 bits says which bins are
    in whole; only the bin at the edge is ranked.
    """
    if not 0 <= removed <= 1:
        raise ValueError("the removed share lies between 0 and 1")
    hashed = records.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")))
    hashed = hashed.withColumn("_bin", F.substring("_h", 1, 4))
    counts = {b: n for b, n in hashed.groupBy("_bin").count().collect()}
    wanted, below, edge = round((1 - removed) * sum(counts.values())), 0, ""
    for edge in sorted(counts):
        if below + counts[edge] >= wanted:
            break
        below += counts[edge]
    whole = hashed.where(F.col("_bin") < edge)
    last = hashed.where(F.col("_bin") == edge).orderBy("_h", id_col).limit(wanted - below)
    return whole.unionAll(last).drop("_h", "_bin")
