"""Line deduplication over levelled sorted runs of line hashes, with DataFrame operations only.

The index is a small log-structured merge tree. A *run* is a table of the 128-bit hashes of line
keys, bucketed and sorted by hash. Documents come in batches of ascending id. Each batch merge-anti-
joins the runs: a key found in one is owned by an earlier document, so all its lines in the batch go.
Of the other keys, the smallest document of the batch becomes the owner; they form the batch's own
run on level 0. Where a level has `fanout` runs they are merged into one run of the next level, so a
batch meets at most (fanout - 1) * levels of them. As runs are bucketed by the join key, only the
batch is shuffled, never the index.

The texts are read twice: once to write the narrow lines, (id, hash of the text, position, hash of the
key), on which all batches work, and once to take out what goes.

No join is on a hash alone: whether a line stays is asked by (hash, document), so a line that a third
of all documents share spreads over all tasks; owners are found by a partial aggregate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm._common import BLANK, NO_ID, doc_key, lower_ascii, scope, stored, whole_text

_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(did, th, pos, h1, h2) of each line whose key has at least `min_chars` code points.

    docs has did (a long that isn't null) and text; th, a hash of the text, tells apart rows that
    share an id.
    """
    lines = docs.select("did", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("did", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineIndex:
    """The levels of runs; tables of the session's catalog, in the shared warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("a level holds at least 2 runs before it is compacted")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"simloom_run_{uuid.uuid4().hex}"
        keys.select(*_HASH).repartition(self.buckets, *_HASH).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) that no run holds."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), _HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add keys that no run holds; compact each level that is full."""
        self.levels[0].append(self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionAll(self.spark.table(name))
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def line_drops(lines: DataFrame, index: LineIndex) -> DataFrame:
    """One batch of lines_of(): (did, th, pos) of the lines that go, a stored table; the batch's new keys join the index.

    All documents of the batch have larger ids than those the index has seen.
    """
    with scope(lines.sparkSession) as keep:
        owners = lines.groupBy(*_HASH).agg(F.min("did").alias("did"))
        new = stored(index.unseen(owners))
        drops = keep(stored(lines.join(new, [*_HASH, "did"], "left_anti").select("did", "th", "pos")))
        index.add(new)
    return drops


def batch_ends(rows: DataFrame, batches: int) -> list[int]:
    """Up to batches - 1 ascending ids, each the last of its batch. Rows without an id don't count and go last."""
    if batches < 2:
        return []
    cuts = rows.where(F.col("did") < NO_ID).approxQuantile("did", [k / batches for k in range(1, batches)], 0.01)
    return sorted({max(-(2**63), min(int(x), NO_ID - 1)) for x in cuts})  # as doubles, the largest ids round up


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept) for each row of docs.

    Lines are split at \\n; a null or empty text is one empty line. Keys of at least `min_chars` code
    points lose their lines in all documents but the smallest id that holds them. A null id counts as
    larger than any other (as does the largest long). Rows that share an id count as one document that
    holds the lines of all of them. An empty table gives no rows. Other columns play no part. Pass an
    `index` to go on from earlier batches; else a new one is made and dropped, also if a batch fails.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), doc_key(id_col).alias("did"), whole_text(text_col).alias("text"))
    own = index or LineIndex(spark, fanout)
    edges = [None, *batch_ends(rows.select("did"), batches), None]
    try:
        with scope(spark) as keep:
            lines = stored(lines_of(rows.select("did", "text"), min_chars))
            drops = None
            for low, high in zip(edges, edges[1:]):
                part = lines if low is None else lines.where(F.col("did") > low)
                part = part if high is None else part.where(F.col("did") <= high)
                found = line_drops(part, own)
                drops = found if drops is None else drops.unionAll(found)
            gone = keep(stored(drops.groupBy("did", "th").agg(F.collect_set("pos").alias("gone"))))
    finally:
        if index is None:
            own.drop()
    split = rows.withColumn("th", F.xxhash64("text")).join(gone, ["did", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    left = split.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.col("lines")[i]), "\n"))
    return left.select(
        "doc_id", F.col("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
