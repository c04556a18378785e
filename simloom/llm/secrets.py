"""Secret scans: fixed patterns, and a guess-cost estimate for values in credential contexts.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them, a value that
stands in a credential context (after words such as `passphrase`, `pwd is`, `Authorization: Bearer`,
or as the password of a URL) is a secret if it is hard to guess. The cost of guessing is the least,
over all ways of cutting the value into segments, of the product of the segments' guesses: common
words by rank (capitals and letter-like digits cost a factor; words are those of the corpus itself,
by the number of documents that have them, and a list of frequent passwords), dates and years, repeats, alphabetic
or numeric sequences, keyboard walks, and brute force by character class. A dynamic programme finds
that minimum in time linear in the value's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import batch_of, pieces, scope, stored

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: As long runs only: a shorter greedy match would be dropped, and none inside it can be longer.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Contexts of the method; each has the value as its only group.
CONTEXTS = (
    re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|credentials?|access[ _-]?key)["']?\s*(?:is|are|was|[:=]>?|->)\s*["'`]?([^\s"'`,;<>]{6,})""", re.I | re.A),
    re.compile(r"""(?:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]{12,})""", re.I | re.A),
    # user and password of any length, the user may be missing; linear, as neither goes beyond a slash
    re.compile(r"""://[^\s/:@]*:([^\s/@]{6,})@"""),
)
#: Frequent passwords and words in them, the most frequent first, then what prose says of credentials.
WORDS = """password 123456 qwerty admin welcome letmein monkey dragon master login princess abc123 football baseball
sunshine iloveyou shadow superman batman trustno1 hello freedom whatever secret summer winter spring autumn love
money access flower cheese computer internet test guest user root default changeme pass server system service
example sample demo dummy placeholder your the my key token api public private local host prod dev stage
not case sensitive required optional invalid valid incorrect wrong correct missing expired empty unknown hidden encrypted hashed
encoded protected stored shared generated provided entered changed forgotten unique random strong weak secure temporary never always""".split()
#: Letters of one case look like a word that no list has; ten random ones cost about this much.
ONE_CASE = 14.0
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: A word of the corpus is in so many documents, and in one of so many.
LEAST, SHARE = 3, 5000
#: Letters between bounds; those beside digits or underscores are parts of names and keys.
_WORD = re.compile(r"\b[^\W\d_]{2,}\b")
_LEET = str.maketrans("013457@$!", "oieastasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


class Words:
    """Ranks of words, those of the fixed list included, and the sizes that occur."""

    def __init__(self, ranked: list[str] = ()) -> None:
        self.ranked = ranked

    @cached_property
    def ranks(self) -> dict[str, int]:
        out = {w: i + 1 for i, w in enumerate(self.ranked)}
        return out | {w: min(i, out.get(w, i)) for w, i in _RANK.items()}

    @cached_property
    def sizes(self) -> list[int]:
        return sorted({len(w) for w in self.ranks})


FIXED = Words()


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on a keyboard whose rows are shifted by half a key."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row, start=y > 0)}
    return {a: {b for b, (u, v) in place.items() if b != a and abs(v - y) <= 1 and abs(u - x) <= 1} for a, (x, y) in place.items()}


_NEAR = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _runs(text: str, joined) -> list[int]:
    """For each position, where the longest run that ends there starts; joined(i, a): does i go on with the run from a.

    A run that can't go on may leave its last character to the next one: joined(i, i - 1).
    """
    out = [0] * len(text)
    for i in range(1, len(text)):
        out[i] = out[i - 1] if joined(i, out[i - 1]) else i - 1 if joined(i, i - 1) else i
    return out


def segments(value: str, words: Words = FIXED) -> list[tuple[str, int, int]]:
    """The cheapest segmentation: (kind, start, end) in order."""
    return guess_cost(value, words)[1]


def guess_cost(value: str, words: Words = FIXED) -> tuple[float, list[tuple[str, int, int]]]:
    """The decimal logarithm of the guesses that the cheapest segmentation needs, and that segmentation."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change length when lower-cased
        low = value
    plain = low.translate(_LEET)
    same = _runs(low, lambda i, _: low[i] == low[i - 1])
    step = lambda i: ord(low[i]) - ord(low[i - 1])
    order = _runs(low, lambda i, a: abs(step(i)) == 1 and low[i].isalnum() and (i - 1 == a or step(i) == step(i - 1)))
    walk = _runs(low, lambda i, _: low[i] in _NEAR.get(low[i - 1], ()))
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            for end in {m.end(), i + 4} if low[i : i + 2] in ("19", "20") and low[i : i + 4].isdigit() else {m.end()}:
                dates.setdefault(end, []).append(i)  # a date's year is one by itself too
    # states of a prefix: 0, it ends in another kind; 1, it ends in brute force, which may go on as one segment
    best = [[math.inf] * (n + 1) for _ in range(2)]
    back = [[("", 0, 0)] * (n + 1) for _ in range(2)]
    best[0][0] = 0.0

    def before(a: int) -> tuple[float, int]:
        """What the prefix up to a costs if a new segment follows, which doubles the ways to arrange them; its state."""
        state = int(best[1][a] < best[0][a])
        return best[state][a] + (math.log10(2) if a else 0), state

    def offer(kind: str, a: int, b: int, cost: float) -> None:
        head, state = before(a)
        if head + cost < best[0][b]:
            best[0][b], back[0][b] = head + cost, (kind, a, state)

    kinds = (
        ("repeat", same, lambda a, k: _brute(low[a]) + math.log10(k)),
        ("sequence", order, lambda a, k: math.log10(36) + math.log10(k)),
        ("walk", walk, lambda a, k: math.log10(47) + (k - 1) * math.log10(2.2)),
    )
    # starts within the run that may still be cheapest; none of these costs grows faster with the length
    # the longer the segment is, so a start that an earlier one has caught up with never leads again
    starts: list[list[int]] = [[], [], []]
    for b in range(1, n + 1):
        head, state = before(b - 1)
        more = best[1][b - 1]
        best[1][b], back[1][b] = min((head, state), (more, 1))[0] + _brute(value[b - 1]), ("brute", b - 1, 1 if more < head else state)
        for size in words.sizes:
            if (a := b - size) < 0:
                break
            if (rank := words.ranks.get(low[a:b])) is not None:
                offer("word", a, b, math.log10(rank) + (0 if value[a:b] == low[a:b] else math.log10(2)))
            elif (rank := words.ranks.get(plain[a:b])) is not None:
                offer("word", a, b, math.log10(rank) + math.log10(4))
        for a in dates.get(b, ()):
            offer("date", a, b, math.log10(120 if b - a == 4 else 365 * 120))
        for i, (kind, run, cost) in enumerate(kinds):
            a = b - 3
            if a < run[b - 1]:
                starts[i] = []
                continue
            kept, least = [], math.inf
            for start in (*starts[i], a):
                total = before(start)[0] + cost(start, b - start)
                if total < least:
                    kept.append(start)
                    least = total
            starts[i] = kept[-1:] if kind == "walk" else kept  # a walk's cost is linear, so the lead stays
            offer(kind, kept[-1], b, cost(kept[-1], b - kept[-1]))
    out, b = [], n
    state = int(best[1][n] < best[0][n])
    total = best[state][n]
    while b:
        kind, a, state = back[state][b]
        if out and kind == "brute" and out[-1][0] == "brute":
            out[-1] = (kind, a, out[-1][2])
        else:
            out.append((kind, a, b))
        b = a
    return total, out[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def one_case(value: str) -> bool:
    """Are these letters alone, all small but for the first, or all capitals?"""
    return value.isalpha() and (value[1:] == value[1:].lower() or value == value.upper())


def guessed_spans(text: str, base: list[tuple[int, int, int]], cost: float, words: Words = FIXED) -> list[tuple[int, int, int]]:
    """Values in credential contexts that no base span touches and that cost at least 10**cost guesses.

    Letters of one case, which may be a word of prose, must cost 10**ONE_CASE at least.
    """
    found = {(m.start(1), 3, m.end(1)) for context in CONTEXTS for m in context.finditer(text)}
    out: list[tuple[int, int, int]] = []
    # one merge of both sorted lists: the base spans that start before b, and the furthest end of those
    at, reach = 0, 0
    for a, kind, b in sorted(found):
        while b > a and text[b - 1] in ".)]}":
            b -= 1
        if out and a < out[-1][2]:
            continue
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if reach > a or at < len(base) and base[at][0] < b:
            continue
        value = text[a:b]
        if len(value) >= 6 and guess_cost(value, words)[0] >= (max(cost, ONE_CASE) if one_case(value) else cost):
            out.append((a, kind, b))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def words_in(text: str) -> set[str]:
    """The words of a text, lower-cased, without those in values of credentials: a secret that is copied is no word."""
    held = sorted({m.span(m.re.groups) for pattern in (ASSIGN, *CONTEXTS) for m in pattern.finditer(text)})
    if held:
        parts, at = [], 0
        for a, b in held:
            parts.append(text[at : max(a, at)])
            at = max(at, b)
        text = " ".join([*parts, text[at:]])
    return set(_WORD.findall(text.lower()))


def corpus_words(rows: DataFrame, least: int = LEAST, share: int = SHARE) -> Words:
    """The words in at least `least` documents and one in `share` of all, the most frequent first. rows has text.

    One in `share` keeps at most `share` times as many words as a document has on average. Counts of
    a task leave it as a row for each word, early if there are many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_in(text or ""))
                counts[""] += 1  # all documents
            if len(counts) > 500_000:
                yield batch_of(schema, list(counts.items()))
                counts.clear()
        yield batch_of(schema, list(counts.items()))

    with scope(rows.sparkSession):
        counted = stored(rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        total = counted.where("word = ''").first()
        found = counted.where((F.col("word") != "") & (F.col("n") >= max(least, -(-(total.n if total else 0) // share)))).toArrow()
    pairs = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return Words([w for _, w in pairs])


_OUT = pa.schema(
    [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cost: float = 9.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) with a row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text is
    empty. A first pass counts the corpus's words, which are broadcast; then each row is scanned by
    itself, whole, without a shuffle. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(corpus_words(rows).ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(held.value)
        for batch in pieces(batches):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                own = guessed_spans(text, base, cost, words)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*count, len(own), hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + own))))
            found = batch_of(_OUT, out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["doc_id", *_OUT.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def op3_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("n_guess")
