"""Helpers shared by the corpus operators: shared scratch tables, sizing, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.scratch import batch_rows, drop, scope, scratch_folder, stored

__all__ = ["BLANK", "NO_ID", "batch_of", "batch_rows", "bucketed", "bytes_of", "doc_key", "drop", "lower_ascii", "partitions_for", "pieces", "row_hash", "scope", "scratch_folder", "stored", "whole_text"]

#: Documents without an id sort after all others and share this internal id.
NO_ID = 2**63 - 1
#: The ASCII white space that separates words in every contract of this subpackage.
BLANK = " \t\n\x0b\x0c\r"


@contextmanager
def bucketed(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """df as a table of the session's catalog, in the shared warehouse, bucketed and sorted by keys; it is dropped at the end.

    Joins and aggregates on these keys read it without a shuffle, however often.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"simloom_{uuid.uuid4().hex}"
    try:
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, or 0 if it has none (then it says 8 EB or some product of them)."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 54 else 0


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Partitions for a shuffle of df: the session's number, or more if df is estimated larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_of(df) // bytes_each)


def doc_key(id_col: str = "doc_id") -> Column:
    """The id as a long that orders and joins; null stands after all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def whole_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashable(field: T.StructField) -> Column:
    """The column, or its JSON where a map in it can't be hashed."""
    own = F.col(f"`{field.name}`")
    return F.to_json(F.struct(own)) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else own


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, that tells nulls in different columns apart."""
    return F.xxhash64(*(x for f in docs.schema for x in (_hashable(f), F.col(f"`{f.name}`").isNull())))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `rows` rows and, beyond one row, about `size` bytes."""
    for batch in batches:
        n, each = batch.num_rows, max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, size // each))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
