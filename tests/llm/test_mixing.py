import random
import re

from pyspark.sql import functions as F

from simloom.llm import mixing as m, queries


def fill(sizes, weights, share, most):
    """Targets by the contract's words: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, got):
    sizes, taken, largest = {}, {}, {}
    for d, text, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    targets = fill(sizes, (3, 1, 2), 1.5, 2)
    for x in got:
        assert x.source_size == sizes[x.source]
        assert abs(x.target - targets[x.source]) < 1e-6 * max(1, x.target)
        assert 0 <= x.copies <= 2
        taken[x.source] = taken.get(x.source, 0) + x.copies * x.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]


def test_targets_sizes_and_reruns(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a"] * 20 + ["b", "é", "B", "z"])) for i in range(3000)]
    rows += [(None, "x y", None), (5000, None, "a"), (5001, "", "empty"), (7, "same text", "b"), (7, "same text", "b")]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, size int")
    got = m.mix(docs, chunk_rows=50, fan=4).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = m.mix(docs.repartition(3), chunk_rows=50, fan=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.copies)
    assert sorted(got, key=str) == sorted(again, key=str)


def test_query_over_the_tables(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, m.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    for x in queries.queries()["op8_mixing"](spark, sf).collect():
        assert x.taken in (0, x.size, 2 * x.size)


def test_exchange_keeps_words_and_expectation():
    rng = random.Random(2)
    for _ in range(2000):
        p, q, s, t = rng.random(), rng.random(), rng.randint(1, 50), rng.randint(1, 50)
        ends = []
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        for u in (0.0, 1.0):
            a, b = m.exchange(p, s, q, t, u)
            assert abs(a * s + b * t - p * s - q * t) < 1e-9 and {a, b} & {0.0, 1.0}
            ends.append(a)
        chance = down / (up + down)
        assert abs(chance * ends[0] + (1 - chance) * ends[1] - p) < 1e-9


def test_the_mix_itself_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i) for i in range(40)] + [(3, "a b c", "s", 3)] * 3 + [(None, None, None, 1)], "doc_id long, text string, source string, times int")
    out = m.mixed(docs)
    assert out.columns == docs.columns
    assert abs(out.where("source = 's'").count() - 1.5 * 43) < 1
    assert m.mixed(docs.limit(0)).count() == 0 and m.mix(docs.limit(0)).count() == 0


def test_many_sources_are_numbered_across_ranges(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 9), f"host{rng.randrange(400)}") for i in range(4000)] + [(9000, "w", None)]
    check(rows, m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_rows_of_one_id_and_text_keep_their_sources(spark):
    rows = [(i % 100, "one two three", "ab"[i // 100], {"k": i // 100}) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    first = sorted(map(str, m.mixed(docs).collect()))
    assert first == sorted(map(str, m.mixed(docs.orderBy(F.desc("source")).repartition(3)).collect()))
    taken = {s: sum(f"source='{s}'" in x for x in first) for s in "ab"}
    want = {x.source: x.target / 3 for x in m.mix(docs).collect()}
    assert all(abs(taken[s] - want[s]) <= 1 for s in "ab")


def test_very_long_texts(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "x" * 1_000_000, "a"), (3, "w", "b")]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(x.size for x in got) == [1, 1, 400_000]
    check(rows, got)
