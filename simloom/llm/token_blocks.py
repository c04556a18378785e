"""Token-id output as patched frame-of-reference blocks.

A corpus is tokenised, ordered by document id and written as *shards*, one for each range of ids.
A shard is a sequence of *segments*; a segment is a self-contained byte string (layout below) held
as one row of a Parquet container, so that Spark's own committer makes the write safe against lost
executors and retried tasks, on any store that Spark reaches.

Segment (little endian)::

    magic "SLT1" | u32 documents | u64 ids | u32 block size | u32 blocks
    documents x i64 document id | documents x u8 id is null | documents x u64 ids of the document
    (blocks + 1) x u64 start of each block, counted from the first block
    blocks, each: u32 minimum | u8 width | u16 exceptions
                  | packed low bits of (id - minimum), `width` bits each
                  | exceptions x u16 position | exceptions x u32 high part

Within a block the minimum is subtracted. The width is the number of bits that the chosen percentile
of the differences needs; larger ones keep their low bits in the packed part and their high part in
the exception list.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm._common import batch_rows, doc_key, partitions_for, pieces, scratch_folder, whole_text

MAGIC = b"SLT1"
_HEAD = struct.Struct("<4sIQII")
_BLOCK = struct.Struct("<IBH")

SEGMENTS = "shard long, segment long, shard_start long, n_docs long, n_ids long, payload binary"
_SEGMENTS = pa.schema(
    [("shard", pa.int64()), ("segment", pa.int64()), ("shard_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
)

# ---------------------------------------------------------------- codec


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each uint32 of a 2-d array, packed row by row."""
    if not width:
        return np.zeros((len(rows), 0), np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 4), axis=2, count=width, bitorder="little")
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """Inverse of _pack for a 2-d array of packed rows."""
    if not width:
        return np.zeros((len(data), count), np.uint32)
    bits = np.unpackbits(data, axis=1, count=count * width, bitorder="little").reshape(len(data), count, width)
    low = np.packbits(bits, axis=2, bitorder="little")
    out = np.zeros((len(data), count, 4), np.uint8)
    out[:, :, : low.shape[2]] = low
    return out.view("<u4")[:, :, 0]


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack_ids(ids: np.ndarray, block_size: int = 1024, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Block starts (blocks + 1 of them) and the blocks of an array of uint32 ids."""
    n = len(ids)
    blocks = -(-n // block_size)
    parts: list[bytes] = [b""] * blocks
    full = n // block_size
    groups = [(0, ids[: full * block_size].reshape(full, block_size))] if full else []
    if n % block_size:
        groups.append((full, ids[full * block_size :].reshape(1, -1)))
    for first, rows in groups:
        low = rows.min(axis=1)
        diff = (rows - low[:, None]).astype(np.uint32)
        at = max(0, min(rows.shape[1] - 1, int(np.ceil(percentile * rows.shape[1])) - 1))
        widths = _bit_length(np.partition(diff, at, axis=1)[:, at])
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            packed = _pack(diff[own], int(width))
            high = diff[own] >> np.uint32(width) if width < 32 else np.zeros_like(diff[own])
            for k, b in enumerate(own):
                where = np.flatnonzero(high[k])
                parts[first + b] = (
                    _BLOCK.pack(int(low[b]), int(width), len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + high[k][where].astype("<u4").tobytes()
                )
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum([len(p) for p in parts], out=starts[1:]) if blocks else None
    return starts, b"".join(parts)


def unpack_blocks(starts: np.ndarray, data: bytes, n: int, block_size: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks first..last (excluded); any block can be read without the others."""
    blocks = len(starts) - 1
    last = blocks if last is None else last
    out = np.zeros(max(0, min(n, last * block_size) - first * block_size), "<u4")
    heads = [_BLOCK.unpack_from(data, int(starts[b])) for b in range(first, last)]
    by: dict[tuple[int, int], list[int]] = {}
    for b, (_, width, _) in zip(range(first, last), heads):
        by.setdefault((width, min(block_size, n - b * block_size)), []).append(b)
    for (width, count), own in by.items():
        size = -(-count * width // 8)
        packed = np.frombuffer(b"".join(data[int(starts[b]) + _BLOCK.size : int(starts[b]) + _BLOCK.size + size] for b in own), np.uint8).reshape(len(own), size)
        rows = _unpack(packed, count, width)
        for row, b in zip(rows, own):
            low, _, n_out = heads[b - first]
            at = int(starts[b]) + _BLOCK.size + size
            if n_out:
                where = np.frombuffer(data, "<u2", n_out, at)
                row[where] |= np.frombuffer(data, "<u4", n_out, at + 2 * n_out) << np.uint32(width)
            to = (b - first) * block_size
            out[to : to + count] = row + np.uint32(low)
    return out


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block_size: int = 1024, percentile: float = 0.9) -> bytes:
    if not 0 < block_size <= 65536:
        raise ValueError("a block holds 1 to 65536 ids")
    starts, blocks = pack_ids(np.ascontiguousarray(ids, np.uint32), block_size, percentile)
    return b"".join(
        (
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), block_size, len(starts) - 1),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            blocks,
        )
    )


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids of a segment."""
    magic, docs, n, block_size, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    numbers = np.frombuffer(payload, "<i8", docs, at)
    nulls = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    starts = np.frombuffer(payload, "<u8", blocks + 1, at)
    ids = unpack_blocks(starts, payload[at + 8 * (blocks + 1) :], n, block_size)
    return [None if z else int(x) for x, z in zip(numbers, nulls)], lengths, ids


# ---------------------------------------------------------------- tokenising

#: White space as the byte-level pattern sees it (the Unicode property White_Space),
#: Latin letters, and ASCII punctuation but the apostrophe, which may open a contraction.
_SPACE = r" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"
#: The byte-level pattern breaks a text at the edge between any two of these pieces, so that no merge
#: crosses it: Latin words and runs of marks where one ends at the other or at white space, else
#: everything up to white space, and the white space itself.
_ONE = rf" ?[{_LETTER}]+(?=[{_MARK}{_SPACE}]|\Z)| ?[{_MARK}]+(?=[{_LETTER}{_SPACE}]|\Z)"
_PIECE = re.compile(rf"{_ONE}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A piece that the pattern leaves whole, so that the merges can be asked for directly.
_WHOLE = re.compile(rf" ?(?:[{_LETTER}]+|[{_MARK}]+)")
_BLANK_EDGE = re.compile(rf"\A[{_SPACE}]|[{_SPACE}]\Z")
_WORD_ENTRIES, _PIECE_ENTRIES, _CACHE_CHARS = 800_000, 300_000, 40


class _Unsafe(Exception):
    """White space stands beside the space at which a text was split."""


class _Pieces(dict):
    """Encoded pieces; a new one is encoded when it is first asked for. Long ones aren't kept, nor those that _Words keeps."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        shown = {x: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(x)[0][0] for x in map(chr, range(128))}
        high = {x: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0] for x in range(0xC0, 0x100)}
        self.table = {ord(x): y for x, y in shown.items()} | high

    def encoded(self, piece: str, whole: bool) -> bytes:
        if whole:
            ids = [x.id for x in self.merge(piece.translate(self.table))]
        else:
            ids = self.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        data = self.encoded(piece, bool(_WHOLE.fullmatch(piece)))
        if len(piece) <= _CACHE_CHARS:
            if len(self) >= _PIECE_ENTRIES:
                self.clear()
            self[piece] = data
        return data


class _Words(dict):
    """Encoded words of a text split at single spaces, each with the space before it."""

    def __init__(self, parts: _Pieces):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> bytes:
        if not word or _BLANK_EDGE.search(word):
            raise _Unsafe
        spaced = " " + word
        data = self.parts.get(spaced) or self.parts.encoded(spaced, True) if _WHOLE.fullmatch(word) else b"".join(map(self.parts.__getitem__, _PIECE.findall(spaced)))
        if len(word) <= _CACHE_CHARS:
            if len(self) >= _WORD_ENTRIES:
                self.clear()
            self[word] = data
        return data


class Encoder:
    """Token ids of whole texts, as little-endian uint32 bytes.

    A byte-level vocabulary splits a text at white space before it merges, so each word is encoded
    once by the tokenizers library and then found in a bounded cache. Any other vocabulary, and a
    text that holds the string of an added token, is encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = self._added_tokens(vocabulary)
        self.parts = _Pieces(self.tokenizer)
        self.words = _Words(self.parts)

    @staticmethod
    def _added_tokens(vocabulary: str) -> list[str] | None:
        """The strings of added tokens if the vocabulary is a plain byte-level one, else None."""
        kind = json.loads(vocabulary)
        pre = kind.get("pre_tokenizer") or {}
        plain = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        return [x["content"] for x in kind.get("added_tokens") or []] if plain else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.added is None or any(x in text for x in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Unsafe
            head = b"".join(map(self.parts.__getitem__, _PIECE.findall(first)))
            return head + b"".join(map(self.words.__getitem__, rest))
        except _Unsafe:
            return b"".join(map(self.parts.__getitem__, _PIECE.findall(text)))


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


# ---------------------------------------------------------------- Spark


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
    block_size: int = 1024, percentile: float = 0.9, segment_ids: int = 1 << 20, partitions: int | None = None,
) -> None:
    """Encode whole texts and write them in ascending id order as segments to `path`.

    vocabulary: the JSON text of a tokenizer of the tokenizers library (a few MB, broadcast).
    A null text is empty and still gets its end id. Null ids stand last. Rows that share an id stand
    next to each other, ordered by a hash of the text. An empty table writes an empty container.
    A segment closes at the first document end beyond `segment_ids` ids, so memory is bounded by that
    and the longest document. The one shuffle moves compressed texts, once.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), doc_key(id_col).alias("key"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = partitions or partitions_for(rows)
    dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), _encoder(held.value), np.array([end_id], "<u4").tobytes()
        segment = start = size = 0
        ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            payload = write_segment(ids, lengths, np.frombuffer(b"".join(parts), "<u4"), block_size, percentile)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, segment, start, len(ids), size, payload), _SEGMENTS)], schema=_SEGMENTS)

        for batch in pieces(batches, 1024, 2 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder.encode(text)
                ids.append(doc)
                lengths.append(len(data) // 4 + 1)
                parts += (data, end)
                size += lengths[-1]
                if size >= segment_ids:
                    yield close()
                    segment, start, size = segment + 1, start + size, 0
                    ids, lengths, parts = [], [], []
        if ids:
            yield close()

    with batch_rows(spark, 1024):
        dealt.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of a container: doc_id, start, n_tokens, ids_crc32[, ids].

    `start` counts the ids of all documents before this one. Only the number of ids of each shard
    comes to the driver (a row for each file range, not for each document).
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    before, total = {}, 0
    for shard, n in sorted(map(tuple, table.groupBy("shard").agg(F.sum("n_ids")).collect())):
        before[shard], total = total, total + n
    held = spark.sparkContext.broadcast(before)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for shard, shard_start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs, lengths, ids = read_segment(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [docs, starts + (held.value[shard] + shard_start), lengths, crc]
                if with_ids:
                    columns.append([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return table.select("shard", "shard_start", "payload").mapInArrow(documents, ddl)


def op1_token_blocks(spark: SparkSession, docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """The contract's digest: documents encoded, written in the file format and read back."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        vocabulary = f.read()
    path = scratch_folder(spark)
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path)
