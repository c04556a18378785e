"""Hamming LSH: a block key for each pass, from bits at seeded positions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose_positions(count: int, size: int, bits: int, seed: int) -> list[list[int]]:
    """For each pass the positions of its key: `size` draws, repeats dropped, in the order drawn.

    size 0 gives empty keys: one block that holds all pairs.
    """
    rng = random.Random(seed)
    return [list(dict.fromkeys(rng.randrange(bits) for _ in range(size))) for _ in range(max(1, count))]


def block_key(bit, positions: list[int]) -> Column:
    """The bits at the positions as a text of 0 and 1; bit(p) is the column of bit p."""
    return F.concat(F.lit(""), *(bit(p).cast("string") for p in positions))


def word_bit(prefix: str = "w"):
    """bit(p) for filters in word columns."""
    return lambda p: F.getbit(F.col(f"{prefix}{p // 64}"), F.lit(p % 64))


def block_keys(rows: DataFrame, passes: list[list[int]], bit) -> DataFrame:
    """rows, once for each pass, with pass and blk."""
    keys = F.array(*(F.struct(F.lit(i).alias("pass"), block_key(bit, p).alias("blk")) for i, p in enumerate(passes)))
    return rows.withColumn("_b", F.explode(keys)).select(*rows.columns, "_b.pass", "_b.blk")


def block_stats(keys: DataFrame) -> DataFrame:
    """Number, smallest, largest, mean and median size of the blocks of all passes."""
    n = F.col("n")
    return keys.groupBy("pass", "blk").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("blocks"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n).alias("median")
    )
