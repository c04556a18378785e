import hashlib
import re

import pytest

from simloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=13):
    w = words(text)
    hit, found = set(), set()
    for item, other in items:
        v = words(other)
        for i in range(max(1, len(v) - size + 1)) if v else ():
            p = v[i : i + size]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


A = "The quick brown fox jumps over the lazy dog while nine cats watch it from a roof"
ITEMS = [(1, A), (2, "Ünly two"), (10, "one"), (3, None), (4, "..."), (5, A.upper()), (6, "the the the the the the the the the the the the the the")]
TEXTS = [A, "x " * 50 + A, None, "", "ünly, TWO! ones", "One", "the " * 30, A.replace("fox", "cow"), "a-b_c\n" + A[4:], "one " + "z " * 40, "one " + "z " * 10]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_equals_brute_force_in_any_blocks(spark, block):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0), (None, A, 0)], "doc_id long, text string, hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(x) for x in d.digest(d.search(docs, bench, block_patterns=block)).collect()]
    want = [(i, *brute(t, ITEMS)) for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (None, A)]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables_and_filter_keep_columns(spark):
    docs = spark.createDataFrame([(1, A, 9), (2, "clean words", None)], "doc_id long, text string, key int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.remove_contaminated(docs, bench).collect() == [(2, "clean words", None)]
    assert d.remove_contaminated(docs, bench.limit(0)).count() == 2
    assert d.digest(d.search(docs.limit(0), bench)).count() == 0


def test_very_long_texts(spark):
    """A passage at the start, in the middle and at the end of a text of 300,000 words, and nearly one everywhere."""
    clean = " ".join(f"w{i}" for i in range(100_000))
    near = " ".join([A[:-4] + "barn"] * 20_000)
    rows = [(1, f"{A} {clean} {A} {clean} {clean} {A}"), (2, near), (3, "the " * 200_000), (4, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in d.digest(d.search(docs, bench)).collect()}
    n = len(words(A))
    shared = len(words(A[:-4])) + 1
    first = 20_000 * (n - 1) if n - 1 >= 13 else 0
    assert got[1] == (300_000 + 3 * n, 3 * n, 1)
    assert got[2] == (20_000 * shared, first, int(first > 0))
    assert got[3] == (200_000, 0, 0) and got[4] == (1, 0, 0)
