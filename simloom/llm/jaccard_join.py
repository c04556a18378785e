"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; two are linked if their Jaccard similarity is at least the
threshold. Documents with equal sets are one *class*, joined by its representative (the smallest id).

A set is embedded as `tokens` min-hash values, so that two sets share a token with a probability that
equals their similarity. A *run* is a tree of paths (Christiani and Pagh's chosen path, in the join
form of CPSJoin): a node samples 1.25 tokens on average (one in threshold), by a hash of its own
path, and its records split by the values of each. Nodes of one record end, small nodes are leaves,
and so are those that keep at least the threshold's share of the node above: their records agree as
often as linked ones do, and another split would only copy them. All others split again, so that a
path's nodes shrink by the threshold at least and the depth follows from the data. The expected number
of nodes that a pair shares never falls with the depth if its similarity is at the threshold; how
often a tree loses the pair nevertheless follows from the branching process. All runs share the
tokens, of which a pair agrees in a binomial number; runs are repeated until the mean over that number
meets the target recall at the largest depth that occurred.

Leaves are brute-forced. A leaf of any size is cut into chunks of bounded records and bytes, and pairs
of chunks are separate work for separate tasks. Of the leaves that a pair shares only one owns it, so
that it is counted once without pairs ever leaving a task. Candidates (by the low bytes of their 128
tokens) are confirmed on whole shingle sets. What leaves a task is a row for each record: its links,
and an edge towards the root of its local component. Components come from alternating star contraction
over those edges. Texts and sets go to Python in small batches, and no other column of the documents
ever does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import batch_rows, bucketed, doc_key, drop, partitions_for, pieces, row_hash, scope, stored
from simloom.llm.substring_dedup import _mix, window_hashes, word_hashes
from simloom.operators.graph import marks

_U = np.uint64


# ---------------------------------------------------------------- sets and tokens


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin.

    A text of fewer words than `size`, but not none, is one shingle.
    """
    data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    words, offsets = word_hashes(b" ".join(data))
    counts = np.diff(np.searchsorted(offsets, np.cumsum([0] + [len(x) + 1 for x in data])))
    rolled, out, at = window_hashes(words, size, 1), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        else:
            out.append(window_hashes(words[at : at + n], n, 1) if n else words[:0])
        at += n
    sizes = [len(x) for x in out]
    return np.concatenate(out) if out else words[:0], np.cumsum([0] + sizes)


def fingerprints(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    pairs = []
    for salt in (1, 2):
        sums = np.zeros(len(values) + 1, _U)
        np.cumsum(_mix(values * _U(2 * salt + 1) ^ _U(salt << 40)), out=sums[1:])
        pairs.append(_mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(_U)))
    return pairs[0], pairs[1]


def min_tokens(values: np.ndarray, starts: np.ndarray, tokens: int, seed: int) -> np.ndarray:
    """One row of `tokens` 32-bit min-hash values for each set that isn't empty (others: zeros)."""
    out = np.zeros((len(starts) - 1, tokens), np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        rng = np.random.default_rng(seed)
        for k in range(tokens):
            a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
            hashed = (values ^ b) * (a * _U(2) + _U(1))
            hashed ^= hashed >> _U(29)
            out[full, k] = _mix(np.minimum.reduceat(hashed, starts[full])).astype(np.uint32)
    return out


# ---------------------------------------------------------------- paths


def losses(threshold: float, depth: int, agree: float | None = None) -> float:
    """The chance that a pair shares no node of a tree at `depth`, if it agrees in that part of its tokens (the threshold)."""
    agree = threshold if agree is None else agree
    extra = 1 / threshold - 1
    lost = 0.0
    for _ in range(depth):
        one = 1 - agree + agree * lost
        lost = (1 - extra) * one + extra * one * one
    return lost


def least_agreeing(threshold: float, tokens: int) -> int:
    """Five standard deviations below the number of tokens that a pair at the threshold agrees in."""
    return int(tokens * threshold - 5 * (tokens * threshold * (1 - threshold)) ** 0.5)


def missed(threshold: float, depth: int, runs: int, tokens: int) -> float:
    """The chance that a pair at the threshold is no candidate: the mean over the tokens that it agrees in."""
    least, out = least_agreeing(threshold, tokens), 0.0
    for x in range(tokens + 1):
        ways = math.lgamma(tokens + 1) - math.lgamma(x + 1) - math.lgamma(tokens - x + 1)
        chance = math.exp(ways + x * math.log(threshold) + (tokens - x) * math.log1p(-threshold)) if threshold < 1 else float(x == tokens)
        out += chance * (losses(threshold, depth, x / tokens) ** runs if x >= least else 1.0)
    return out


def runs_for(threshold: float, depth: int, recall: float, tokens: int = 128) -> int:
    """Runs until a pair at the threshold is found with the target recall."""
    if missed(threshold, depth, 10_000, tokens) > 1 - recall:
        raise ValueError(f"{tokens} tokens are too few for a recall of {recall}")
    runs = 1
    while missed(threshold, depth, runs, tokens) > 1 - recall:
        runs += 1
    return runs


def children(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): each node samples one token, or two with probability 1/threshold - 1, by its path's hash."""
    t = _U(tokens.shape[1])
    own = _mix(paths ^ _U(0x5851F42D4C957F2D))
    first = own % t
    step = _mix(own + _U(1))
    second = (first + _U(1) + step % (t - _U(1))) % t
    two = (_mix(own + _U(2)) >> _U(11)).astype(np.float64) / 2.0**53 < 1 / threshold - 1
    rows = np.arange(len(paths))
    out_rows = np.concatenate([rows, rows[two]])
    picks = np.concatenate([first, second[two]])
    values = tokens[out_rows, picks.astype(np.int64)].astype(_U)
    return out_rows, _mix(_mix(paths[out_rows] * _U(3) + picks) ^ _mix(values + _U(0x2545F4914F6CDD1D)))


# ---------------------------------------------------------------- leaves


def candidates(low: np.ndarray, leaf: int, leaves: list[np.ndarray], side: np.ndarray | None, least: int) -> np.ndarray:
    """Pairs (i < j) of a block whose tokens agree often enough and that this leaf owns, as a matrix.

    low: the tokens' low bytes. leaves: of each record, those below this one at least. side: the record's chunk where the
    block is of two chunks, else None. The smallest leaf that a pair shares owns it.
    """
    n = len(low)
    found = np.zeros((n, n), bool)
    step = max(1, (16 << 20) // max(1, n * low.shape[1]))
    for a in range(0, n, step):
        found[a : a + step] = (low[a : a + step, None, :] == low[None, :, :]).sum(axis=2, dtype=np.uint16) >= least
    found &= np.triu(np.ones((n, n), bool), 1)
    if side is not None:
        found &= side[:, None] != side[None, :]
    if found.any():
        rows = np.repeat(np.arange(n), [len(x) for x in leaves])
        every = np.concatenate(leaves)
        rows, every = rows[every < leaf], every[every < leaf]
        order = np.argsort(every, kind="stable")
        for group in np.split(rows[order], np.flatnonzero(np.diff(every[order])) + 1):
            if len(group) > 1:
                found[np.ix_(group, group)] = False
    return found


def confirm(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of the matrix whose sets have at least that Jaccard similarity."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    out = np.zeros_like(pairs)
    i, j = np.nonzero(pairs)
    if len(i) <= 4 * n:
        same = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:
        words, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.full(len(words), -1)
        shared = np.flatnonzero(count > 1)
        place[shared] = np.arange(len(shared))
        row, col = np.repeat(np.arange(n), sizes), place[at]
        common = np.zeros((n, n), np.float32)
        step = max(1, (4 << 20) // n)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for a in range(0, len(shared), step):
            u, v = np.searchsorted(col, (a, a + step))
            part = np.zeros((n, step), np.float32)
            part[row[u:v], col[u:v] - a] = 1
            common += part @ part.T
        same = common[i, j].astype(np.int64)
    # at least the threshold, in whole numbers up to rounding of the threshold itself
    ok = same >= threshold * (sizes[i] + sizes[j] - same) - 1e-9
    out[i[ok], j[ok]] = True
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """For each record, the first record of its component in the block."""
    n = len(links)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in np.flatnonzero(links[a]).tolist():
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


# ---------------------------------------------------------------- Spark


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        columns = [np.asarray(table.column(k)) for k in range(keys)]
        new = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-1]).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _binary(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


_NODE = ["did", "fp"]
#: Rows of an Arrow batch that hold texts, tokens or sets.
_ROWS = 1024


def with_sets(docs: DataFrame, size: int, columns: list[Column], what: str, tokens: int = 128, seed: int = 10) -> DataFrame:
    """The given columns of docs and of each text: f1, f2, n, and its tokens and their low bytes, or its set.

    docs has text; what is "tokens" or "set".
    """
    rows = docs.select(F.struct(*columns).alias("own"), F.col("text").cast("string").alias("text"))
    names = ["tokens", "low"] if what == "tokens" else ["set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512, 1 << 19):
            values, starts = shingles(batch.column(1).to_pylist(), size)
            f1, f2 = fingerprints(values, starts)
            arrays = [batch.column(0), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(np.diff(starts).astype(np.int64))]
            if what == "tokens":
                found = min_tokens(values, starts, tokens, seed)
                arrays += [pa.array([x.tobytes() for x in t], pa.binary()) for t in (found, found.astype(np.uint8))]
            else:
                arrays.append(pa.array([values[a:b].astype("<u8").tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["own", "f1", "f2", "n", *names])

    kind = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"own {kind}, f1 long, f2 long, n long" + "".join(f", {x} binary" for x in names)).select("own.*", "f1", "f2", "n", *names)


def leaves_of(records: DataFrame, threshold: float, runs: range, small: int, tokens: int) -> tuple[DataFrame, int]:
    """(leaf, did, fp, n, shingles), and the depth: the leaves of two records and more that each record is in.

    n and shingles: the records of each leaf and the sum of their sets' sizes. Each level is a table in
    the shared folder. Rows of leaves leave; those of other nodes meet their tokens again, by record,
    and split.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0)
            own = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(nodes.offsets)))
            path, above = (np.asarray(x) for x in nodes.flatten().flatten())
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, tokens)
            rows, out = children(path.view(_U), values[own], threshold)
            take = pa.array(own[rows])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(above[rows]), *(batch.column(k).take(take) for k in (2, 3, 4))], names=["leaf", "above", *_NODE, "words"])

    every = records.select(*_NODE, F.col("n").alias("words"), "tokens")
    total = F.lit(records.count()).cast("long").alias("above")
    rows = every.withColumn("nodes", F.array(*(F.struct(F.lit(r).cast("long").alias("leaf"), total) for r in runs)))
    found, depth = None, 0
    while True:
        depth += 1
        with batch_rows(records.sparkSession, _ROWS):
            nodes = stored(rows.select("nodes", "tokens", *_NODE, "words").mapInArrow(split, "leaf long, above long, did long, fp long, words long"))
        # stored, so that the join has an exchange on either side, whose large partitions Spark can split
        counts = stored(nodes.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("words").alias("shingles")).where("n > 1"))
        known = stored(nodes.join(counts, "leaf"))
        drop(nodes, counts)
        ends = (F.col("n") <= small) | (F.col("n") >= F.lit(threshold) * F.col("above"))
        here = known.where(ends).select("leaf", *_NODE, "n", "shingles")
        found = here if found is None else found.unionByName(here)
        large = known.where(~ends)
        if large.isEmpty():
            return found, depth
        # a record is in few nodes: as many as the runs, times a factor for each level
        rows = large.groupBy(*_NODE).agg(F.collect_list(F.struct("leaf", F.col("n").alias("above"))).alias("nodes")).join(every, _NODE)


def _dealt(leaves: DataFrame, small: int, chunk: int, set_bytes: int) -> DataFrame:
    """(leaf, a, b, mine, did, fp): each record in each block, a pair of chunks a <= b of its leaf.

    A chunk of a leaf has about `chunk` records, or up to `small` where it is the only one, and sets of
    about `set_bytes` bytes, at most.
    """
    k = F.greatest(F.when(F.col("n") <= small, F.lit(1)).otherwise(F.ceil(F.col("n") / chunk)), F.ceil(F.col("shingles") * 8 / set_bytes))
    own = F.pmod(F.xxhash64(*_NODE), k)
    rows = leaves.withColumn("k", k).withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return rows.select("leaf", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", *_NODE)


_KEYS = ["leaf", "a", "b"]


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, depth: int = 4, small: int = 512, chunk: int = 256, set_bytes: int = 8 << 20, tokens: int = 128, seed: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, links and components.

    documents: (doc_id, did, th, f1, f2, n) with a row for each row of docs; th is a hash of the text.
    records: (did, fp, f2, size), a class of documents with equal sets each, named by its smallest id
    and a hash of the set. linked: (did, fp, to_did, to_fp, links), rows of records with the number of
    documents that one task has linked with them (add these up) and a record of the same component.

    Trees are first made for a depth of `depth`; where nodes go deeper, the runs that this needs follow.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col).alias("did"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    with scope(spark) as keep:
        with batch_rows(spark, _ROWS):
            wide = stored(with_sets(base, size, [F.col("doc_id"), F.col("did"), F.col("th")], "tokens", tokens, seed))
        grouped = wide.where("n > 0").groupBy("f1", "f2").agg(F.min("did").alias("did"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("low").alias("low"))
        # tokens are met by record at every level and in every block: they are dealt by record once
        with bucketed(grouped.withColumnRenamed("f1", "fp"), *_NODE) as known:
            every = keep(stored(wide.drop("tokens", "low")))
            n = partitions_for(wide)
            drop(wide)
            made, deepest, found = 0, depth, None
            while made < (need := runs_for(threshold, deepest, recall, tokens)):
                more, reached = leaves_of(known, threshold, range(made + 1, need + 1), small, tokens)
                found = more if found is None else found.unionByName(more)
                made, deepest = need, max(deepest, reached)
            leaves = stored(found)
            linked = keep(_linked(base, every, known, leaves, size, threshold, least_agreeing(threshold, tokens), small, chunk, set_bytes, tokens, n))
            records = keep(stored(known.drop("tokens", "low", "n")))
    return every, records, linked


def _linked(base: DataFrame, every: DataFrame, records: DataFrame, leaves: DataFrame, size: int, threshold: float, least: int, small: int, chunk: int, set_bytes: int, tokens: int, n: int) -> DataFrame:
    """links()'s third table: blocks of chunks propose pairs by their tokens' low bytes, then whole sets confirm them."""
    spark = base.sparkSession

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.int64()) for x in (*_KEYS, *_NODE)] + [("bits", pa.binary())])
        out: list[list] = [[] for _ in schema]
        for block in _blocks(batches, 3):
            if block.num_rows < 2:
                continue
            order = np.lexsort((np.asarray(block["fp"]), np.asarray(block["did"])))
            block = block.take(pa.array(order))
            values = np.frombuffer(b"".join(block["low"].to_pylist()), np.uint8).reshape(-1, tokens)
            leaf, a, b = (block[x][0].as_py() for x in _KEYS)
            lists = [np.array(x, np.int64) for x in block["leaves"].to_pylist()]
            found = candidates(values, leaf, lists, np.asarray(block["mine"]) if a < b else None, least)
            keep = np.flatnonzero(found.any(axis=0) | found.any(axis=1))
            if len(keep):
                own = found[np.ix_(keep, keep)]
                take = block.select(["did", "fp"]).take(pa.array(keep))
                for column, x in zip(out, ([leaf] * len(keep), [a] * len(keep), [b] * len(keep), take["did"].to_pylist(), take["fp"].to_pylist(), [np.packbits(r).tobytes() for r in own])):
                    column += x
            if len(out[0]) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    sketched = records.select(*_NODE, "low").join(leaves.groupBy(*_NODE).agg(F.collect_list("leaf").alias("leaves")), _NODE)
    deal = _dealt(leaves, small, chunk, set_bytes).join(sketched, _NODE)
    # of a record's leaves, those below this one can own its pairs
    deal = deal.withColumn("leaves", F.filter("leaves", lambda x: x < F.col("leaf"))).repartition(n, *_KEYS).sortWithinPartitions(*_KEYS).select(*_KEYS, "mine", *_NODE, "low", "leaves")
    with batch_rows(spark, _ROWS):
        proposed = stored(deal.mapInArrow(propose, "leaf long, a long, b long, did long, fp long, bits binary"))
    drop(leaves)

    wanted = stored(proposed.select(*_NODE).distinct())
    # one document of each wanted record gives its set
    named = every.select("did", "th", F.col("f1").alias("fp")).join(wanted, _NODE, "left_semi").groupBy(*_NODE).agg(F.min("th").alias("th"))
    # the joins of whole texts have one plan at every size: both sides by id, however few rows are wanted
    texts = base.join(stored(named).select("did", "th").hint("merge"), ["did", "th"], "left_semi").select("did", "th", "text").dropDuplicates(["did", "th"])
    with batch_rows(spark, _ROWS // 4):
        sets = stored(with_sets(texts, size, [F.col("did")], "set").select("did", F.col("f1").alias("fp"), "set"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.int64()) for x in (*_NODE, "to_did", "to_fp", "links")])
        for block in _blocks(batches, 3):
            order = np.lexsort((np.asarray(block["fp"]), np.asarray(block["did"])))
            block = block.take(pa.array(order))
            m = block.num_rows
            pairs = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x in block["bits"].to_pylist()], bool)
            good = confirm(_binary(block["set"]), pairs, threshold)
            both = good | good.T
            keep = np.flatnonzero(both.any(axis=0))
            if not len(keep):
                continue
            root, weight = roots(good)[keep], both.astype(np.int64) @ np.asarray(block["size"])
            did, fp = np.asarray(block["did"]), np.asarray(block["fp"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[keep], fp[keep], did[root], fp[root], weight[keep])], schema=schema)

    checked = proposed.join(records.select(*_NODE, "size"), _NODE).join(sets, _NODE).repartition(n, *_KEYS).sortWithinPartitions(*_KEYS)
    checked = checked.select(*_KEYS, *_NODE, "bits", "set", "size")
    with batch_rows(spark, _ROWS // 4):
        return stored(checked.mapInArrow(verify, "did long, fp long, to_did long, to_fp long, links long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component. edges: (x, y) of structs, x != y.

    Alternating star contraction (Kiveris et al. 2014): in turn, each node links all its larger and
    all its smaller neighbours to its smallest one, until stars are left. Edges stay as many or
    fewer; each round is a table in the shared folder.
    """
    rows = stored(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    mark = marks(rows)
    for _ in range(max_rounds):
        both = rows.unionAll(rows.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("of"), F.least("x", "m").alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, F.col("x") == F.col("of")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = stored(large.distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "of")
        met = large.join(least, F.col("x") == F.col("of"))
        small = met.select(F.col("y").alias("x"), F.col("m").alias("y")).where(F.col("x") != F.col("y")).unionAll(met.select("x", F.col("m").alias("y")))
        new = stored(small.distinct())
        before, mark = mark, marks(new)
        drop(rows, large)
        rows = new
        if mark == before:
            return rows.select(F.col("x").alias("node"), F.col("y").alias("root"))
    raise RuntimeError("components didn't settle")


def _node(did: str = "did", fp: str = "fp") -> Column:
    return F.struct(F.col(did).alias("did"), F.col(fp).alias("fp"))


def labelled(records: DataFrame, linked: DataFrame) -> DataFrame:
    """(did, fp, size, root, links) of each record: its component's first record, and its linked documents of other classes."""
    edges = linked.where(_node() != _node("to_did", "to_fp")).select(_node().alias("x"), _node("to_did", "to_fp").alias("y"))
    roots_ = components(edges).select(F.col("node.did").alias("did"), F.col("node.fp").alias("fp"), "root")
    count = linked.groupBy(*_NODE).agg(F.sum("links").alias("links"))
    return records.join(count, _NODE, "left").join(roots_, _NODE, "left").select(*_NODE, "f2", "size", F.coalesce("root", _node()).alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) with a row for each row of docs.

    class_id: the smallest id of the documents that links connect with it. n_links: the other rows
    whose sets have at least the threshold, equal ones included. Null ids count as larger than any
    other (and a class of such documents alone has a null class_id). Null and empty texts, and others
    without words, have no links; each is its own class. Repeated rows link with each other. An empty
    table gives no rows.
    """
    with scope(docs.sparkSession) as keep:
        every, records, linked = links(docs, **options)
        named = labelled(records, linked).select(F.col("fp").alias("f1"), "f2", F.col("root.did").alias("class"), (F.col("links") + F.col("size") - 1).alias("n_links"))
        found = keep(stored(named))
        rows = keep(stored(every.select("doc_id", "did", "f1", "f2", "n")))
    full = rows.where("n > 0").join(found, ["f1", "f2"]).select("doc_id", F.col("class"), "n_links")
    empty = rows.where("n = 0").select("doc_id", F.col("did").alias("class"), F.lit(0).cast("long").alias("n_links"))
    none = 2**63 - 1
    return full.unionAll(empty).select("doc_id", F.when(F.col("class") != none, F.col("class")).alias("class_id"), "n_links")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group that links connect, that of the smallest id, with all its columns.

    Documents without words stay. Of several rows with the smallest id the one of the least hash of its
    text, then of all its columns stays, so that of repeated rows there is one. Which rows go is decided
    on ids and hashes alone; then the rows of docs meet those that go, once, and never pass through
    Python.
    """
    with scope(docs.sparkSession) as keep:
        every, records, linked = links(docs, id_col=id_col, text_col=text_col, **options)
        first = labelled(records, linked).where(F.col("root") == _node()).select("did", F.col("fp").alias("f1"), "f2")
        full = every.where("n > 0")
        least = full.join(first, ["did", "f1", "f2"]).groupBy("did", "f1", "f2").agg(F.min("th").alias("th")).select("did", "th")
        stays = stored(least.withColumn("stays", F.lit(True)))
        texts = full.groupBy("did", "th").agg(F.count("*").alias("rows")).join(stays, ["did", "th"], "left")
        # texts of which no row stays as it is: none at all, or one of several
        out = keep(stored(texts.where("stays IS NULL OR rows > 1").select("did", "th", F.col("stays").isNotNull().alias("one"))))
    keyed = docs.select(F.struct("*").alias("row"), doc_key(id_col).alias("did"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), row_hash(docs).alias("rh"))
    kept = keyed.join(out.select("did", "th").hint("merge"), ["did", "th"], "left_anti").select("row.*")
    # repeated rows meet in partial aggregates, however many there are
    one = keyed.join(out.where("one").select("did", "th"), ["did", "th"], "left_semi").groupBy("did", "th").agg(F.min_by("row", "rh").alias("row"))
    return kept.unionAll(one.select("row.*"))


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    return join(docs)
