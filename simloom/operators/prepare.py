"""From records to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.functions import bloom
from simloom.functions.estimators import qgram_estimate
from simloom.functions.text import bigrams, gram_key
from simloom.scratch import stored


def dedup_count(rows: DataFrame, key: str, id_col: str = "row_idx") -> DataFrame:
    """The row of the smallest id for each key, with node_count, the number of rows that had it.

    Counting and choosing are one partial aggregate; the rows follow by a join on the chosen ids, so a
    key that a third of all rows share is no single task.
    """
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.min(id_col).alias("_id"), F.count("*").alias("node_count"))
    return rows.join(best.select("_id", "node_count"), rows[id_col] == F.col("_id")).drop("_id")


def plain_nodes(records: DataFrame, attributes: list[str], padding: bool = False, id_col: str = "row_idx") -> DataFrame:
    """(nid, key, grams, qgrams_count, node_count): records with equal sets of bigrams are one node."""
    rows = records.select(F.col(id_col).alias("nid"), bigrams(*attributes, padding=padding).alias("grams"))
    rows = dedup_count(rows.withColumn("key", gram_key(F.col("grams"))), "key", "nid")
    return rows.select("nid", "key", "grams", F.size("grams").cast("double").alias("qgrams_count"), "node_count")


def encode_records(records: DataFrame, attributes: list[str], hashes: int = 10, length: int = 1024, padding: bool = False, id_col: str = "row_idx") -> DataFrame:
    """(row_idx, base64_bf): the Bloom filter of each record; a record without bigrams has an empty filter."""
    rows = records.select(F.col(id_col).alias("row_idx"), bigrams(*attributes, padding=padding).alias("grams"))
    words = bloom.words_of(bloom.positions(rows, hashes=hashes, length=length), length=length)
    names = bloom.word_names(length)
    full = rows.select("row_idx").join(words, "row_idx", "left").select("row_idx", *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in names))
    return full.select("row_idx", bloom.encode(length).alias("base64_bf"))


def encoded_nodes(records: DataFrame, column: str = "base64_bf", length: int = 1024, hashes: int = 10, id_col: str = "row_idx") -> DataFrame:
    """(nid, key, bits, qgrams_count, node_count, w0..wK): records with equal filters are one node."""
    rows = records.select(F.col(id_col).alias("nid"), F.col(column).alias("key"))
    names = bloom.word_names(length)
    # the words are stored: later expressions would otherwise hold the whole decoding in each place that reads one
    rows = stored(dedup_count(rows, "key", "nid").select("nid", "key", "node_count", *bloom.decode(F.col("key"), length)))
    rows = rows.withColumn("bits", bloom.popcount(names))
    return stored(rows.select("nid", "key", "bits", qgram_estimate(F.col("bits"), length, hashes).alias("qgrams_count"), "node_count", *names))


def ground_truth(plain: DataFrame, encoded: DataFrame, rule: str = "kept") -> DataFrame:
    """(nid, u_key, v_key): plain and encoded keys of one row.

    plain and encoded have nid and key. rule "kept": the rows that stay on either side after
    deduplication, joined by id. "all_rows": both are tables of all rows, so that a pair is found
    even where the sides kept different copies.
    """
    if rule not in ("kept", "all_rows"):
        raise ValueError("rule is kept or all_rows")
    pairs = plain.select("nid", F.col("key").alias("u_key")).join(encoded.select("nid", F.col("key").alias("v_key")), "nid")
    return pairs if rule == "kept" else pairs.groupBy("u_key", "v_key").agg(F.min("nid").alias("nid")).select("nid", "u_key", "v_key")


def side_ids(nodes: DataFrame, side: str) -> DataFrame:
    """nodes with id, `u_` (plain) or `v_` (encoded) before the key, and side."""
    if side not in ("u", "v"):
        raise ValueError("side is u or v")
    return nodes.withColumn("side", F.lit(side)).withColumn("id", F.concat(F.lit(f"{side}_"), F.col("key")))


def strip_prefix(column: str):
    return F.substring(F.col(column), 3, 1 << 30)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """rows with node_count beside each, for callers that keep all of them."""
    return rows.withColumn("node_count", F.count("*").over(W.partitionBy(key)))
