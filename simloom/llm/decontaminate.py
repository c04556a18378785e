"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `size` consecutive words of benchmark items; an item of fewer words, but
not none, is one pattern. Patterns of one length form a searcher. It looks at the last `block` words
of the current position: the shift table says how far the position can move because no pattern ends
there, and where the shift is 0, a suffix bucket and in it a prefix bucket select the patterns that
direct comparison confirms.

Benchmarks are read in blocks of at most `block_patterns` patterns, each searched in all documents,
so that what a task holds is bounded for any benchmark; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm._common import pieces, stored

#: Lower-cases A-Z and turns every byte that no word has into a space. Words are of digits, a-z and all beyond ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bench_words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(b, m + 1):
                key = words[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets.setdefault(words[m - b :], {}).setdefault(words[:b], []).append((words, items))

    def find(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Mark the words inside any occurrence and add the items whose patterns occur."""
        m, b, far, shift, buckets, n = self.length, self.block, self.far, self.shift.get, self.buckets, len(words)
        mark, end = b"\x01" * m, m
        while end <= n:
            tail = tuple(words[end - b : end])
            step = shift(tail, far)
            if step:
                end += step
                continue
            at = end - m
            for pattern, of in buckets[tail].get(tuple(words[at : at + b]), ()):
                if tuple(words[at:end]) == pattern:
                    hit[at:end] = mark
                    items.update(of)
            end += 1


def searchers(patterns: dict[tuple[bytes, ...], list[str]]) -> list[Searcher]:
    by: dict[int, dict] = {}
    for words, items in patterns.items():
        by.setdefault(len(words), {})[words] = items
    return [Searcher(by[k]) for k in sorted(by)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[list[Searcher]]:
    """Searchers for one block of patterns after the other; the driver holds one block at a time."""
    patterns: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator(prefetchPartitions=False):
        for words in windows(bench_words(text), size):
            patterns.setdefault(words, []).append("null" if item is None else item)
            if len(patterns) >= most:
                yield searchers(patterns)
                patterns = {}
    if patterns:
        yield searchers(patterns)


_FOUND = "n_words long, hit binary, items array<string>"
_FOUND_ARROW = [pa.field("n_words", pa.int64()), pa.field("hit", pa.binary()), pa.field("items", pa.list_(pa.string()))]


def search(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_patterns: int = 200_000, keep: Column | None = None) -> DataFrame:
    """Rows of `docs` as (key, n_words, hit, items).

    key: the id, or the column `keep`. hit: one byte a word, 1 inside any occurrence of a pattern,
    or null if there is none. items: the ids, as strings, of the items with occurring patterns,
    each once. Null and empty texts have no words; an empty benchmark hits nothing; repeated rows
    are judged one by one; items that share an id count as one.
    """
    spark = docs.sparkSession
    rows = docs.select((F.col(id_col) if keep is None else keep).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def scan(tables: list[Searcher] | None, first: bool, last: bool = False):
        held = spark.sparkContext.broadcast(tables or [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                out: list[list] = [[], [], []]
                before = [None] * batch.num_rows if first else batch.column(3).to_pylist()
                names = [[]] * batch.num_rows if first else batch.column(4).to_pylist()
                for text, old, known in zip(batch.column(1).to_pylist(), before, names):
                    words = bench_words(text)
                    hit, items = bytearray(old or len(words)), set(known)
                    for x in held.value:
                        x.find(words, hit, items)
                    for column, x in zip(out, (len(words), bytes(hit) if items else None, sorted(items))):
                        column.append(x)
                own = batch.columns[: 1 if last else 2]  # the last pass leaves the texts behind
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, f.type) for x, f in zip(out, _FOUND_ARROW))], names=[*("key", "text")[: len(own)], *(f.name for f in _FOUND_ARROW)])

        return run

    found, waiting = rows, None
    for tables in _blocks(benchmark, item_col, item_text_col, size, block_patterns):
        if waiting is not None:  # one more block: what is found so far goes to the shared folder
            found = stored(found.mapInArrow(scan(*waiting), f"key {kind}, text string, {_FOUND}"))
        waiting = (tables, waiting is None)
    return found.mapInArrow(scan(*(waiting or (None, True)), last=True), f"key {kind}, {_FOUND}")


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """The contract's rule: some word is hit, and at least one in `share` words."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def hit_count(hit: Column) -> Column:
    """Ones in the bytes of `hit`: its hexadecimal digits hold no other 1."""
    return F.when(hit.isNull(), F.lit(0)).otherwise(F.length(F.translate(F.hex(hit), "0", ""))).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows that search() returns."""
    return found.withColumn("n_hit", hit_count(F.col("hit"))).select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The documents that the contract's rule leaves, with all their columns."""
    row = search(docs, benchmark, size=size, keep=F.struct("*"))
    return row.where(~contaminated(F.col("n_words"), hit_count(F.col("hit")), share)).select("key.*")


def op9_decontamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return digest(search(docs, benchmark))
