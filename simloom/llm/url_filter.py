"""URL filters by a sort-merge range join with nested rules.

A host's labels in reverse order, each closed by the lowest character, form a canonical key under
which a host and all its subdomains are one interval. Pages are range-partitioned and sorted by key
(and by a hash, so that a host with a third of all pages is many tasks); rules are sorted by the same
key. One sweep over both keeps a stack of the rules whose intervals are open: they are nested. A
page's candidates are the rules on the stack whose path starts the page's path; the longest wins.

Rules are read in blocks of at most `block_rules`, each swept over all pages, so a task's memory has
a bound for any rule table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import lower_ascii, partitions_for, stored

END = "\x00"
#: The rules of the contract: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    return "".join(x + END for x in reversed(host.split(".")))


class Rules:
    """A block of rules: hosts sorted by key, the host that encloses each, and each host's paths."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        by: dict[str, dict[str, str]] = {}
        for verdict, host, path in rules:
            by.setdefault(host, {})[path] = verdict
        self.hosts = sorted(by, key=host_key)
        self.keys = [host_key(x) for x in self.hosts]
        self.paths = [by[x] for x in self.hosts]
        self.lengths = [sorted({len(p) for p in x}, reverse=True) for x in self.paths]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, key in enumerate(self.keys):
            while stack and not key.startswith(self.keys[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def sweep(self, pages: Iterable[tuple[str, str, str]]) -> Iterator[tuple[int, str, str, int] | None]:
        """For pages (key, host, path) sorted by key: length, rule, verdict and host's length of the winner, or None.

        Where the order breaks, as at the start of a task's range, the stack is found by search.
        """
        keys, hosts, n = self.keys, self.hosts, len(self.keys)
        stack: list[int] = []
        at, last = 0, None
        for key, host, path in pages:
            if last is None or key < last:
                at = bisect_right(keys, key)
                stack, i = [], at - 1
                while i >= 0:
                    if key.startswith(keys[i]):
                        stack.append(i)
                    i = self.outer[i]
                stack.reverse()
            last = key
            while at < n and keys[at] <= key:
                while stack and not keys[at].startswith(keys[stack[-1]]):
                    stack.pop()
                stack.append(at)
                at += 1
            while stack and not key.startswith(keys[stack[-1]]):
                stack.pop()
            best = None
            for i in stack:
                if host != hosts[i] and not host.endswith("." + hosts[i]):
                    continue
                for k in self.lengths[i]:
                    verdict = self.paths[i].get(path[:k]) if k <= len(path) else None
                    if verdict is not None:
                        if best is None or len(hosts[i]) + k >= best[0]:  # the inner host is the longer
                            best = (len(hosts[i]) + k, hosts[i] + path[:k], verdict, len(hosts[i]))
                        break
            yield best


def _blocks(rules: DataFrame, most: int) -> Iterator[Rules]:
    block: list[tuple[str, str, str]] = []
    for row in rules.select("verdict", "host", "path").orderBy("host", "path", "verdict").toLocalIterator():
        if not row[1]:
            raise ValueError("a rule needs a host")
        if row[0] not in ("allow", "block"):
            raise ValueError("a rule allows or blocks")
        block.append((row[0], row[1], row[2] or ""))
        if len(block) >= most:
            yield Rules(block)
            block = []
    if block:
        yield Rules(block)


_BEST = [pa.field("length", pa.int64()), pa.field("rule", pa.string()), pa.field("verdict", pa.string()), pa.field("host_length", pa.int64())]


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) with a row for each page.

    rules has verdict (allow or block), host and path; a null path is empty, a path given twice
    with one host keeps the verdict that sorts last. A rule fits its host and all subdomains if the
    page's path starts with the rule's. The longest (host and path together) wins; of two as long,
    that of the longer host. Pages that no rule fits get `default`: so do those with a null url or
    one without `://`, whose host and path are empty. Repeated pages are judged one by one.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), END), F.lit(END))
    rows = rows.withColumn("key", key).withColumn("tie", F.xxhash64("page_id", "path"))
    dealt = rows.repartitionByRange(partitions_for(rows), "key", "tie").sortWithinPartitions("key").select("page_id", "key", "host", "path")
    kind = rows.schema["page_id"].dataType.simpleString()

    def swept(block: Rules, first: bool):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = held.value.sweep(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))))
                if not first:
                    old = zip(*(batch.column(k).to_pylist() for k in (4, 5, 6, 7)))
                    longer = lambda a, b: (a[0], a[3]) >= (b[0], b[3])
                    found = (new if new and (was[0] is None or longer(new, was)) else was for new, was in zip(found, old))
                out = list(zip(*(x or (None,) * 4 for x in found))) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, f.type) for c, f in zip(out, _BEST))], names=["page_id", "key", "host", "path", *(f.name for f in _BEST)])

        return run

    out, waiting = dealt, None
    ddl = f"page_id {kind}, key string, host string, path string, length long, rule string, verdict string, host_length long"
    for block in _blocks(rules, block_rules):
        if waiting:  # one more block: what is found so far goes to the shared folder
            out = stored(out.mapInArrow(swept(*waiting), ddl))
        waiting = (block, waiting is None)
    out = out.mapInArrow(swept(*(waiting or (Rules([]), True))), ddl)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "verdict string, host string, path string"))
