"""Bloom filters: BIGINT word columns w0..wK for pair arithmetic, base64 (bits from the lowest) on disk."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.murmur import murmur3


def word_names(length: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(-(-length // 64))]


def gram_positions(grams: DataFrame, hashes: int, length: int) -> DataFrame:
    """(gram, pos) of the positions that each q-gram sets: hash seeds 0..hashes-1, modulo the length, never negative."""
    seeded = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed"))
    return seeded.select("gram", F.pmod(murmur3(F.col("gram"), F.col("seed")), F.lit(length)).alias("pos"))


def positions(rows: DataFrame, grams: str = "grams", id_col: str = "row_idx", hashes: int = 10, length: int = 1024) -> DataFrame:
    """(id, pos): the set positions of each row's filter, each once.

    Hashes are computed once for each distinct gram and joined: there are far fewer of them than rows.
    """
    long = rows.select(id_col, F.explode(grams).alias("gram"))
    return long.join(gram_positions(long.select("gram").distinct(), hashes, length), "gram").select(id_col, "pos").distinct()


def words_of(bits: DataFrame, id_col: str = "row_idx", length: int = 1024) -> DataFrame:
    """(id, w0..wK) from (id, pos): bit pos % 64 of word pos div 64."""
    bit = lambda k: F.when(F.floor(F.col("pos") / 64) == k, F.expr("shiftleft(1L, cast(pos % 64 as int))")).otherwise(F.lit(0).cast("long"))
    return bits.groupBy(id_col).agg(*(F.bit_or(bit(k)).alias(w) for k, w in enumerate(word_names(length))))


def _turned(digits: Column) -> Column:
    """Sixteen hexadecimal digits with their eight bytes in reverse order."""
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)))


def encode(length: int = 1024, prefix: str = "w") -> Column:
    """base64 of the word columns: byte i holds bits 8i..8i+7, the lowest first."""
    digits = F.concat(*(_turned(F.lpad(F.hex(w), 16, "0")) for w in word_names(length, prefix)))
    # Spark breaks long base64 into lines
    return F.translate(F.base64(F.unhex(F.substring(digits, 1, 2 * -(-length // 8)))), "\r\n", "")


def decode(text: Column, length: int = 1024, prefix: str = "w") -> list[Column]:
    """The word columns of a base64 filter; what is missing of `length` bits is zero."""
    names = word_names(length, prefix)
    digits = F.rpad(F.hex(F.unbase64(text)), 16 * len(names), "0")
    return [F.conv(_turned(F.substring(digits, 16 * k + 1, 16)), 16, -10).cast("long").alias(w) for k, w in enumerate(names)]


def filter_length(rows: DataFrame, column: str) -> int:
    """Bits of the longest filter of the table."""
    return 8 * (rows.agg(F.max(F.octet_length(F.unbase64(column)))).first()[0] or 0)


def set_positions(rows: DataFrame, id_col: str = "row_idx", length: int = 1024, prefix: str = "w") -> DataFrame:
    """(id, pos) of rows with word columns: inverse of words_of()."""
    words = rows.select(id_col, F.posexplode(F.array(*word_names(length, prefix))).alias("k", "word"))
    bits = words.select(id_col, "k", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.getbit("word", F.col("i")) == 1)
    return bits.select(id_col, (F.col("k") * 64 + F.col("i")).alias("pos"))


def popcount(names: list[str]) -> Column:
    return reduce(add, (F.bit_count(F.col(w)) for w in names))


def union_popcount(left: list[Column], right: list[Column]) -> Column:
    return reduce(add, (F.bit_count(a.bitwiseOR(b)) for a, b in zip(left, right)))
