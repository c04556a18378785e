"""Substring deduplication: Rabin-Karp hashes of every window of `size` words.

A word is removed if a window that covers it also starts in a document with a smaller id. There are
as many windows as words, so a row for each would outweigh the texts several times. Instead:

1. Documents are dealt into *blocks*: ranges of ascending ids, of bounded size. Blocks have a rank.
2. Each block hashes its windows (two rolling polynomials over word hashes). One hash's top bits
   choose a bucket, the other is the 64-bit key. A block sends each bucket its sorted distinct keys,
   as differences in byte planes: about six bytes a window.
3. Each bucket counts keys over all blocks and answers every block with one bit a key: whether a
   block of smaller rank holds it.
4. Each block meets its answers, adds what repeats within itself, and merges repeated windows into
   maximal removal intervals.

The texts are shuffled once: the exchange by block serves steps 2 and 4. A passage held by a third of
all documents is one key in each block, so no group grows with it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import NO_ID, doc_key, partitions_for, scope, stored

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SUB = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd
_INVERSES = tuple(pow(x, -1, 1 << 64) for x in _BASES)
_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (between ASCII white space) of `data`, and the offset where each starts."""
    text = np.frombuffer(data, np.uint8)
    inside = ~_BLANK[text]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, _U), first
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum(_BYTE[text] * _powers(_BASES[0], len(text)), out=sums[1:])
    return _mix((sums[last] - sums[first]) * _powers(_INVERSES[0], len(text))[first]), first


def window_hashes(words: np.ndarray, size: int, k: int) -> np.ndarray:
    """Rolling hash number k (1 or 2) of each window of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    own = words if k == 1 else _mix(words ^ _U(_BASES[0]))
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(own * _powers(_BASES[k], len(words)), out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _powers(_INVERSES[k], n))


class Block:
    """The windows of some documents in ascending id order, sorted by bucket and key."""

    def __init__(self, dids: list[int], texts: list[str | None], size: int, buckets: int, piece: int = 1 << 19):
        order = np.argsort(np.array(dids, np.int64), kind="stable")
        self.size, self.order = size, order
        self.texts = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order]
        rank = np.unique(np.array(dids, np.int64)[order], return_inverse=True)[1]
        counts, keys, bucket, starts, doc = [], [], [], [], []
        at = words = 0
        while at < len(self.texts):
            to, total = at, 0
            while to < len(self.texts) and (to == at or total + len(self.texts[to]) <= piece):
                total += len(self.texts[to]) + 1
                to += 1
            hashes, offsets = word_hashes(b" ".join(self.texts[at:to]))
            limits = np.cumsum([0] + [len(x) + 1 for x in self.texts[at:to]])
            n = np.diff(np.searchsorted(offsets, limits))
            own = np.repeat(np.arange(at, to), n)
            ok = np.flatnonzero(own[: max(0, len(own) - size + 1)] == own[size - 1 :]) if len(own) >= size else np.zeros(0, np.int64)
            keys.append(window_hashes(hashes, size, 1)[ok])
            bucket.append((window_hashes(hashes, size, 2)[ok] >> _U(32)) * _U(buckets) >> _U(32))
            starts.append(ok + words)
            doc.append(rank[own[ok]].astype(np.int32))
            counts.append(n)
            words += len(hashes)
            at = to
        none = [np.zeros(0, np.int64)]
        self.counts = np.concatenate(counts or none)
        self.words = words
        keys, bucket = np.concatenate(keys or none).astype(_U), np.concatenate(bucket or none).astype(np.uint32)
        by = np.lexsort((keys, bucket))  # stable, so equal windows stand in id order
        self.keys, self.bucket = keys[by], bucket[by]
        self.starts, self.doc = np.concatenate(starts or none)[by], np.concatenate(doc or none)[by]
        new = np.ones(len(by), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.run = np.cumsum(new) - 1  # number of the distinct key
        self.first = np.flatnonzero(new)

    def distinct(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with its sorted distinct keys."""
        keys, bucket = self.keys[self.first], self.bucket[self.first]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(bucket[a]), keys[a:b]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Marks of the words to remove. earlier: of each distinct key, whether an earlier block has it."""
        gone = earlier[self.run] | (self.doc > self.doc[self.first][self.run]) if len(self.run) else np.zeros(0, bool)
        cover = np.zeros(self.words + 1, np.int32)
        np.add.at(cover, self.starts[gone], 1)
        np.subtract.at(cover, self.starts[gone] + self.size, 1)
        return np.cumsum(cover[:-1]) > 0


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are nearly constant."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


def earlier_block(ranks: list[int], keys: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of keys, which of them a list of smaller rank holds."""
    order = np.argsort(ranks, kind="stable")
    sizes = np.array([len(keys[i]) for i in order])
    every, rank = np.concatenate([keys[i] for i in order]), np.repeat(np.array(ranks)[order], sizes)
    by = np.argsort(every, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = every[by][1:] != every[by][:-1]
    least = rank[by][np.flatnonzero(new)][np.cumsum(new) - 1]
    held = np.zeros(len(by), bool)
    held[by] = rank[by] > least
    out: list[np.ndarray] = [held[:0]] * len(ranks)
    for i, part in zip(order, np.split(held, np.cumsum(sizes)[:-1])):
        out[i] = part
    return out


_KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
_BITS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_RANGE = pa.struct([("from", pa.int64()), ("to", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(_RANGE)), ("kept", pa.string())])


#: Parts that a range of ids is cut into where it holds too many bytes.
_CUTS = 256
#: Keys that a block sends a bucket on average, at least; blocks and buckets grow with the root of the input to keep it.
_LEAST_KEYS = 16


class Places:
    """Which block a document belongs to: ascending ranges of ids of bounded bytes.

    bins: (end, lowest id, highest id, bytes), ascending; a bin holds the ids up to its end. Small
    bins next to each other share a block. A large one that holds one id alone (as that of rows
    without any) is divided by a hash of the text, and these blocks have one rank.
    """

    def __init__(self, bins: list[tuple[int, int, int, int]], target: int):
        self.ends = np.array([b[0] for b in bins[:-1]], np.int64)
        rank, parts, at, room = [], [], -1, 0
        for _, least, most, size in bins:
            n = max(1, -(-size // target)) if least == most else 1
            if at < 0 or n > 1 or size > room:
                at, room = at + 1, target if n == 1 else 0
            rank.append(at)
            parts.append(min(n, 1 << _SUB))
            room -= size
        self.rank, self.parts = np.array(rank), np.array(parts)

    def blocks(self, did: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Numbers of blocks: the rank, and in the low bits which of several of one rank."""
        at = np.searchsorted(self.ends, did)
        return (self.rank[at] << _SUB) + tie % self.parts[at]


def refined(bins: list[tuple], target: int) -> tuple[list[int], bool]:
    """Ends of bins, and whether any is new: those of bins (end, lowest, highest, bytes, quantiles) and, within
    bins of more bytes than the target that hold several ids, their quantiles; an id that is several of them stands alone."""
    ends, new = [], False
    for end, least, most, size, cuts in bins:
        if size > target and least < most:
            own = {c for c in cuts if c < most} | {c - 1 for c in cuts if cuts.count(c) > 1 and c > least}
            ends += sorted(own or {most - 1})
            new = True
        ends.append(end)
    return sorted(set(ends)), new


def _bins(rows: DataFrame, target) -> list[tuple[int, int, int, int]]:
    """The bins of rows (did, text) for Places, none of several ids and more than target(all bytes) bytes.

    Each pass over the ids, a narrow table, cuts the bins that are too large at their quantiles; a few
    passes do, whatever the ids are. As many bins come to the driver as there are blocks, or a few times that.
    """
    with scope(rows.sparkSession):
        sizes = stored(rows.select("did", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")))
        ends = [NO_ID - 1, NO_ID]  # rows without an id are the last bin
        cuts = F.percentile_approx("did", [k / _CUTS for k in range(1, _CUTS)], 10 * _CUTS)
        while True:
            held = rows.sparkSession.sparkContext.broadcast(np.array(ends, np.int64))

            @F.pandas_udf("int")
            def bin_of(did: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(held.value, did.to_numpy()))

            found = sizes.withColumn("bin", bin_of("did")).groupBy("bin").agg(F.min("did"), F.max("did"), F.sum("size"), cuts).collect()
            bins = [(ends[b], low, high, size, list(c)) for b, low, high, size, c in sorted(map(tuple, found))]
            ends, new = refined(bins, target(sum(b[3] for b in bins)))
            if not new:
                return [b[:4] for b in bins]
            ends = sorted({*ends, NO_ID - 1, NO_ID})


def dedup_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13, block_bytes: int = 8 << 20, bucket_windows: int = 2 << 20, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) for each row of docs.

    removed: the maximal intervals of removed words, from (included) to (excluded). kept: the words
    that stay, joined by one space. Windows are judged on the input. A null text has no words, a
    text of fewer than `size` words no window. A null id counts as larger than any other (as does the
    largest long). Rows that share an id are one document to each other: none is smaller. An empty
    table gives no rows.

    Blocks have about block_bytes of text, buckets about bucket_windows windows. Blocks times buckets
    are rows, so from about 1 TB on both are enlarged alike, as the square root of the input, until a row holds
    16 keys and more: about 80 MB and 20 million at 100 TB.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col).alias("did"), F.col(text_col).alias("text"))
    partitions = partitions_for(rows, 64 << 20)
    grow = lambda n_bytes: max(1.0, (_LEAST_KEYS * n_bytes / (block_bytes * bucket_windows)) ** 0.5)
    target = lambda n_bytes: max(1, min(int(block_bytes * grow(n_bytes)), -(-n_bytes // (blocks or partitions))))
    bins = _bins(rows.select("did", "text"), target)
    n_bytes = sum(b[3] for b in bins)
    buckets = min(1 << 24, max(16, int(n_bytes / 6 / (bucket_windows * grow(n_bytes)))))
    held = docs.sparkSession.sparkContext.broadcast(Places(bins, target(n_bytes)) if bins else None)

    @F.pandas_udf("long")
    def block_of(did: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(held.value.blocks(did.to_numpy(), tie.to_numpy()))

    placed = rows.withColumn("block", block_of("did", F.pmod(F.xxhash64("text"), F.lit(1 << _SUB)))).repartition(partitions, "block")

    def send(table: pa.Table) -> pa.Table:
        block = Block(table["did"].to_pylist(), table["text"].to_pylist(), size, buckets)
        number = table["block"][0].as_py()
        out = [(b, number, pack_keys(keys)) for b, keys in block.distinct()]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), _KEYS)], schema=_KEYS)

    def answer(table: pa.Table) -> pa.Table:
        numbers = table["block"].to_pylist()
        found = earlier_block([x >> _SUB for x in numbers], [unpack_keys(x) for x in table["keys"].to_pylist()])
        bits = [np.packbits(x).tobytes() for x in found]
        return pa.table([pa.array(numbers, pa.int64()), table["bucket"].combine_chunks(), pa.array(bits, pa.binary())], schema=_BITS)

    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _OUT.empty_table()
        block = Block(texts["did"].to_pylist(), texts["text"].to_pylist(), size, buckets)
        bits = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()))
        earlier = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(keys)).astype(bool) for b, keys in block.distinct()]
        gone = block.removed(np.concatenate(earlier) if earlier else np.zeros(0, bool))
        ids = texts["doc_id"].take(pa.array(block.order)).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for doc, text, n, to in zip(ids, block.texts, block.counts.tolist(), np.cumsum(block.counts).tolist()):
            own, words = gone[to - n : to], text.split()
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
            if edges:
                words = list(itertools.compress(words, (~own).tolist()))
            row = (doc, n, n - len(words), [{"from": a, "to": b} for a, b in zip(edges[::2], edges[1::2])], b" ".join(words).decode("utf-8", "surrogatepass"))
            for column, x in zip(out, row):
                column.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)

    ddl = lambda schema: ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)
    sent = placed.groupBy("block").applyInArrow(send, ddl(_KEYS)).repartition(max(partitions, n_bytes // (128 << 20)), "bucket")
    answers = sent.groupBy("bucket").applyInArrow(answer, ddl(_BITS))
    out = "doc_id long, n_words long, n_removed long, removed array<struct<`from`:long,`to`:long>>, kept string"
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, out)


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
