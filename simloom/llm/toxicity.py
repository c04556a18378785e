"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the words that a document holds. It is trained with numpy from
documents confirmed as toxic (P) and from unlabelled text (U) with the class prior pi by the
non-negative risk of Kiryo et al. (2017),

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

under logistic loss. Where the estimate of the negative part falls below zero, a step against it
undoes the overfit; steps take all rows, as the estimate of a few is below zero by chance alone. The
words are chosen by their counts over all training documents, in Spark. The fit itself sees a bounded
sample (`most_rows` documents of each kind, chosen by a hash of the id), of which only the chosen words
reach the driver; scoring reads whole texts, one pass, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import batch_of, batch_rows, pieces, scope, stored

#: Rows of an Arrow batch that hold texts, and words that a task counts before their counts leave it.
_ROWS, _COUNTED = 1024, 100_000
#: Lower-cases A-Z; every other byte below 0x80 but digits and letters is a gap.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_ids(text: str | None) -> set[int]:
    """The distinct words of a text as 32-bit checksums."""
    return set(map(zlib.crc32, set((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    """Weights by word; an empty one, where there was nothing to learn from, scores the prior."""

    weights: dict[int, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        x = self.bias + sum(get(w, 0.0) for w in word_ids(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


class _Rows:
    """Documents as rows of a sparse 0/1 matrix over chosen words."""

    def __init__(self, docs: list[np.ndarray], words: np.ndarray):
        every = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        at = np.searchsorted(words, every)
        ok = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == every) if len(words) else np.zeros(len(every), bool)
        self.n, self.row, self.col, self.width = len(docs), row[ok], at[ok], len(words)
        self.starts = np.searchsorted(self.row, np.arange(self.n + 1))

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.starts[rows + 1] - self.starts[rows]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(np.arange(len(rows)), size), self.col[np.repeat(self.starts[rows], size) + within]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def distance(a, b, n: float, m: float, sqrt=np.sqrt):
    """Two-sample z of a word that a of n and b of m documents hold; of numbers, arrays or columns."""
    share = (a + b + 1) / (n + m + 2)
    return (a / n - b / m) / sqrt(share * (1 - share) * (1 / n + 1 / m))


def screen(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int, most: int, sure: float) -> np.ndarray:
    """The words whose share of P differs most from that of U, by a two-sample z of at least `sure`."""
    words, count = np.unique(np.concatenate(positive), return_counts=True)
    words, count = words[count >= least], count[count >= least]
    every, times = np.unique(np.concatenate(unlabelled) if unlabelled else words[:0], return_counts=True)
    at = np.minimum(np.searchsorted(every, words), max(0, len(every) - 1))
    other = np.where(every[at] == words, times[at], 0) if len(every) else np.zeros(len(words))
    z = distance(count, other, len(positive), max(1, len(unlabelled)))
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(words[best[np.abs(z[best]) >= sure]])


def risk(w: np.ndarray, b: float, p: "_Rows", own: np.ndarray, u: "_Rows", other: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """pi * R_P(+), R_U(-) - pi * R_P(-), and the direction of the step: weights, then bias.

    The direction is the gradient of the sum, or where the second part is below zero, of its negative alone.
    """
    (pr, pc), (ur, uc) = p.batch(own), u.batch(other)
    fp = b + np.bincount(pr, w[pc], len(own))
    fu = b + np.bincount(ur, w[uc], len(other))
    positive = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    # derivatives of the losses by the score: -sigmoid(-f) as positive, sigmoid(f) as negative
    gp, gu = -prior * _sigmoid(-fp) / len(own), _sigmoid(fu) / len(other)
    minus = -prior * _sigmoid(fp) / len(own)
    gp, gu = (gp + minus, gu) if negative >= 0 else (-minus, -gu)
    g = np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w))
    return positive, negative, np.append(g, gp.sum() + gu.sum())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, words: np.ndarray | None = None, features: int = 4096, least: int = 3, sure: float = 5.0, epochs: int = 400, batches: int = 1, rate: float = 0.1, decay: float = 5e-5, seed: int = 5) -> Model:
    """The classifier of least non-negative risk, over `words` or those that screen() finds; deterministic for given rows and seed."""
    if not positive or not 0 < prior < 1:
        return Model({}, -60.0 if prior <= 0 else 60.0 if prior >= 1 else math.log(prior / (1 - prior)))
    words = screen(positive, unlabelled, least, features, sure) if words is None else words
    p, u = _Rows(positive, words), _Rows(unlabelled or positive, words)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(words)), math.log(prior / (1 - prior))
    m, v, step = np.zeros(len(words) + 1), np.zeros(len(words) + 1), 0
    for _ in range(epochs):
        deals = zip(np.array_split(rng.permutation(p.n), batches), np.array_split(rng.permutation(u.n), batches))
        for own, other in deals:
            if not len(own) or not len(other):
                continue
            g = risk(w, b, p, own, u, other, prior)[2] + decay * np.append(w, 0.0)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return Model(dict(zip(words.tolist(), w.tolist())), float(b))


def word_counts(rows: DataFrame, positive: frozenset[int], counted: int = _COUNTED) -> DataFrame:
    """(word, p, u): how many rows (doc_id, text) hold each word, of those with a positive id and of all.

    Counts leave a task after `counted` words at most, a document's more, and meet in its partial aggregate; the word None counts all rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(positive)
    schema = pa.schema([("word", pa.int64()), ("p", pa.int64()), ("u", pa.int64())])

    def flush(p: Counter, u: Counter) -> Iterator[pa.RecordBatch]:
        every = iter(u.items())
        while some := list(islice(every, 16_384)):
            yield batch_of(schema, [(w, p.get(w, 0), n) for w, n in some])
        p.clear()
        u.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, u = Counter(), Counter()
        for batch in pieces(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [*word_ids(text), None]
                u.update(own)
                if i in held.value:
                    p.update(own)
                if len(u) > counted:
                    yield from flush(p, u)
        yield from flush(p, u)

    return rows.mapInArrow(run, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _below(share: float) -> Column:
    """Whether the id belongs to that share of ids, by a hash."""
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))


def _sample(rows: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen words of each id of rows (doc_id, text), in id order. Of rows that share an id the least list counts."""
    held = rows.sparkSession.sparkContext.broadcast(frozenset(chosen.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [sorted(word_ids(x) & held.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "words"])

    found = rows.mapInArrow(run, "doc_id long, words array<long>").groupBy("doc_id").agg(F.min("words").alias("words")).toArrow()
    order = np.argsort(np.asarray(found["doc_id"]), kind="stable").tolist()
    lists = found["words"].to_pylist()
    return [np.array(lists[i], np.int64) for i in order]


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", most_rows: int = 12_000, prior: float | None = None, features: int = 4096, least: int = 3, sure: float = 5.0) -> Model:
    """Fit on the rows of docs outside fold 0.

    labels has doc_id and toxic (1 or 0; a null says nothing; of several for a document the largest
    counts). P: labelled toxic, at most about most_rows of them by a hash of the id. U: all training
    documents, P among them, as in any text; words are counted over all of it, and about most_rows ids
    by the same hash fit the weights. The prior is the toxic share of labelled training documents unless
    given. Without toxic labels every score is 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (fold() != 0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return fit([], [], 0.0)
    sure_ids = known.where((F.col("toxic") == 1) & _below(min(1.0, most_rows / toxic))).select("doc_id")
    ids = frozenset(sure_ids.toArrow()["doc_id"].to_pylist())  # about most_rows at most
    with scope(spark):
        with batch_rows(spark, _ROWS):
            counts = stored(word_counts(rows, ids))
        total = counts.where("word IS NULL").first()
        if not total or not total.p:
            return fit([], [], 0.0)
        z = F.abs(distance(F.col("p"), F.col("u"), float(total.p), float(total.u), F.sqrt))
        best = counts.where(F.col("word").isNotNull() & (F.col("p") >= least)).select("word", z.alias("z")).where(F.col("z") >= sure).orderBy(F.desc("z"), "word").limit(features)
        chosen = np.sort(np.array(best.toArrow()["word"].to_pylist(), np.int64))
    held = F.broadcast(spark.createDataFrame([(x,) for x in sorted(ids)], "doc_id long"))
    with batch_rows(spark, _ROWS):
        positive = _sample(rows.join(held, "doc_id", "left_semi"), chosen)
        unlabelled = _sample(rows.where(_below(min(1.0, most_rows / total.u))), chosen)
    return fit(positive, unlabelled, prior if prior is not None else toxic / n, words=chosen)


def score(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """(row, score): each row of docs as a struct, and its score between 0 and 1.

    A null or empty text is scored by the bias alone. Repeated rows get equal scores. Only texts go to
    Python, and only scores come back.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
        return pa.array([held.value.score(x) for part in parts for x in part], pa.float64())

    return docs.select(F.struct("*").alias("row"), score_of(F.col(text_col).cast("string")).alias(column))


def clean(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents scored below the cut, with all their columns."""
    return score(docs, train(docs, labels)).where(F.col("score") < cut).select("row.*")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    out = out.select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
