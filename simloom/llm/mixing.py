"""Mixing sources to target weights by pivotal dependent rounding.

A source's target in words divided by its size is the rate of its documents: each gets the whole part
as copies and the fraction as a probability of one copy more. The fractions of a source are rounded
together: two documents exchange words (one's probability rises as the other's falls, weighed by
their sizes) in a random direction that keeps each expectation, until one of them is 0 or 1. So the
expected words of a source don't change with any exchange, and at most one document of a source is
left for a plain draw: what a source takes is off its target by less than that document's size.

Documents are dealt into chunks by a hash of their id. Each chunk rounds its documents source by
source in one sorted pass, and leaves at most one of each source. The chunks' residuals combine
`fan` chunks at a time in a reduction tree. All draws are seeded by source and chunk, and all orders
are total, so reruns agree whatever the cluster does.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.llm._common import drop, partitions_for, row_hash, scope, stored, whole_text


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) with a row for each source, as a stored table.

    Sources, by code point and null last, take the weights in turn and share `share` times all
    sizes. No target is above `most` times its source's size: what is above is shared again among
    the others. That is a common level, cut off where a source is full; each pass over the sources
    closes those that the level fills and raises it, until none is closed. Sources are numbered range
    by range, so that they may be as many as hosts. All sums are of whole numbers, so reruns agree.
    """
    kinds = len(weights)
    with scope(sized.sparkSession) as keep:
        per = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
        ranged = per.repartitionByRange(partitions_for(per), F.col("source").asc_nulls_last())
        ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
        place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
        starts, before = [], 0
        for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
            starts.append((part, before % kinds))
            before += n
        offsets = sized.sparkSession.createDataFrame(starts, "part int, start int")
        turn = ((F.col("start") + place) % kinds).cast("int")
        rows = stored(ranged.join(offsets, "part").select("source", "source_size", turn.alias("turn")))
        drop(per, ranged)
        weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("turn") + 1)
        full = F.col("source_size") * F.lit(float(most))
        level, closed = 0.0, -1
        while True:
            over = full <= F.lit(level) * weight
            open_ = [F.count(F.when(~over & (F.col("turn") == k), 1)) for k in range(kinds)]
            total, taken, now, *counts = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.count(F.when(over, 1)), *open_).first()
            if now == closed or not any(counts):
                break
            closed = now
            level = (share * total - most * taken) / sum(w * n for w, n in zip(weights, counts))
        target = F.when(over, full).otherwise(F.lit(level) * weight)
        return keep(stored(rows.select("source", "source_size", target.alias("target"))))


_ROW = "key long, doc_id long, source string, size long, source_size long, target double, copies long, p double, chunk long"
_SCHEMA = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("copies", pa.int64()), ("p", pa.float64()), ("chunk", pa.int64())]
)


def exchange(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """New probabilities of two documents of sizes s and t; u decides the direction. One is 0 or 1."""
    up, down = (1 - p) * s - q * t, p * s - (1 - q) * t
    rise, fall = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (rise + fall) < fall:
        return (1.0, max(0.0, q - rise / t)) if up <= 0 else (min(1.0, p + rise / s), 0.0)
    return (0.0, min(1.0, q + fall / t)) if down <= 0 else (max(0.0, p - fall / s), 1.0)


def _rounded(seed: int, level: int, last: bool):
    """A pass over rows sorted by chunk and source: fractions are rounded, residuals keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        group: tuple | None = None
        draw = random.Random()

        def settle(row: list) -> list:  # what one group leaves
            if last:
                row[6] += draw.random() < row[7]
                row[7] = None
            return row

        for batch in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns))):
                own = (row[8], row[2])
                if own != group:
                    if held:
                        out.append(settle(held))
                    held, group = None, own
                    draw.seed(f"{seed}/{level}/{own[0]}/{own[1]!r}")
                if row[7] is None:
                    out.append(row)
                elif row[3] == 0:  # without words there is nothing to exchange
                    row[6], row[7] = row[6] + (draw.random() < row[7]), None
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    held[7], row[7] = exchange(held[7], held[3], row[7], row[3], draw.random())
                    both, held = (held, row), None
                    for x in both:
                        if x[7] in (0.0, 1.0):
                            x[6], x[7] = x[6] + int(x[7]), None
                            out.append(x)
                        else:
                            held = x
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(settle(held), _SCHEMA)], schema=_SCHEMA)

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8, chunk_rows: int = 1024, fan: int = 64) -> DataFrame:
    """(key, doc_id, source, size, source_size, target, copies) with a row for each row of docs.

    copies: how often the mix takes the document, the whole part of its rate or one more, so never
    more than `most` rounded up. key: a hash of the text unless another is given, which with id and
    source names a row up to exact repetition; repeated rows are rounded each by itself. A null text
    has size 0, null is a source of its own, an empty table gives no rows. Where all texts are empty
    all targets are 0.
    """
    key = F.xxhash64(whole_text(text_col)) if key is None else key
    with scope(docs.sparkSession) as keep:
        sized = stored(docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(whole_text(text_col)).alias("size")))
        chunks = max(1, -(-sized.count() // chunk_rows))
        targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "of")
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("copies", F.floor("rate"))
        rows = rows.withColumn("p", F.when(F.col("rate") > F.col("copies"), F.col("rate") - F.col("copies"))).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)))
        names = [f.name for f in _SCHEMA]
        done, level, table = None, 0, sized
        while True:
            last = chunks == 1
            by = ["chunk"] if level == 0 else ["chunk", "source"]
            dealt = rows.select(*names).repartition(partitions_for(rows), *by).sortWithinPartitions("chunk", "source", "doc_id", "size", "key")
            table = keep(stored(dealt.mapInArrow(_rounded(seed, level, last), _ROW)))
            settled = table.where(F.col("p").isNull())
            done = settled if done is None else done.unionAll(settled)
            if level == 0:
                drop(sized)
            if last:
                return done.drop("p", "chunk")
            chunks = -(-chunks // fan)
            rows = table.where(F.col("p").isNotNull()).withColumn("chunk", F.floor(F.col("chunk") / fan).cast("long"))
            level += 1


def mixed(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with all their columns.

    A row is named by its id and a hash of all its columns, so that rows of one id or text that differ
    elsewhere, in their source too, keep their own copies. Rows that are equal in everything are one
    row that is taken as often as all of them together.
    """
    with scope(docs.sparkSession) as keep:
        taken = mix(docs, id_col=id_col, key=row_hash(docs), **options).groupBy(F.col("doc_id").alias("id_"), F.col("key").alias("key_"))
        taken = keep(stored(taken.agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("n"))))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("key"))
    same = (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))
    single = row.join(taken.where("n = 1 AND times > 0"), same).select("row", "times")
    # repeated rows meet in a partial aggregate, however many there are
    equal = row.join(taken.where("n > 1 AND times > 0"), same).groupBy("key", "id").agg(F.min_by("row", "key").alias("row"), F.min("times").alias("times"))
    return single.unionAll(equal.select("row", "times")).select("row", F.explode(F.expr("array_repeat(0, times)"))).select("row.*")


def op8_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
