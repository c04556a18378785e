"""Estimates of q-gram counts and similarities from Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qgram_estimate(bits: Column, length: int, hashes: int) -> Column:
    """-(l/h) ln(1 - b/l): q-grams behind b set bits. Null for a saturated filter, where it is infinite."""
    return F.when(bits < length, -F.lit(length / hashes) * F.log(1 - bits / F.lit(float(length))))


def common_estimate(a: Column, b: Column, union: Column, length: int, hashes: int) -> Column:
    """q-grams common to two filters: those of each less those of the union, not below 0."""
    q = lambda x: qgram_estimate(x, length, hashes)
    return F.greatest(F.lit(0.0), q(a) + q(b) - q(union))


def adjusted_dice(a: Column, b: Column, union: Column, length: int, hashes: int) -> Column:
    """Dice of the estimated counts. 0 where both are empty or any filter, or the union, is saturated."""
    total = qgram_estimate(a, length, hashes) + qgram_estimate(b, length, hashes)
    return F.coalesce(F.try_divide(2 * common_estimate(a, b, union, length, hashes), total), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two arrays without repetition; 0 if both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def hash_count(encoded: DataFrame, bits: str, plain: DataFrame, grams: str, length: int) -> int:
    """Hash functions behind the filters, from the mean of set bits and the mean q-gram count, over whole tables."""
    mean_bits = encoded.agg(F.avg(bits)).first()[0]
    mean_grams = plain.agg(F.avg(F.size(grams))).first()[0]
    if not mean_bits or not mean_grams or mean_bits >= length:
        raise ValueError("the number of hash functions can't be estimated from empty or saturated filters")
    return round(math.log(1 - mean_bits / length) / math.log(1 - 1 / length) / mean_grams)
