import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import jaccard_join as j


def sets_of(texts, size=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(rows, threshold=0.8):
    sets = sets_of([t for _, t in rows])
    n = len(rows)
    link = [[b for b in range(n) if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9] for a in range(n)]
    label = list(range(n))
    for a in range(n):
        todo = [a]
        if label[a] != a:
            continue
        seen = {a}
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        for b in seen:
            label[b] = a
    big = 2**63 - 1
    least = {}
    for a in range(n):
        least[label[a]] = min(least.get(label[a], big), big if rows[a][0] is None else rows[a][0])
    return sorted(((d, None if least[label[a]] == big else least[label[a]], len(link[a])) for a, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=25, size=6, words=120):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 3000)
    shared = [word() for _ in range(30)]
    rows, d = [], 0
    for g in range(groups):
        text = [word() for _ in range(rng.randint(20, words))] + (shared if g % 3 == 0 else [])
        for _ in range(rng.randint(1, size)):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((d, " ".join(own)))
            d += 1
    rng.shuffle(rows)
    return rows


ODD = [(None, None), (1000, ""), (1001, " \n"), (1002, "a b"), (1003, "a  b"), (1004, "b a"), (None, "no id at all here today"), (None, "no id at all here today"), (1005, "x " * 100_000), (1006, "x " * 90_000)]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"small": 2, "chunk": 3})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed) + ODD
    rows += [rows[0], rows[0], (2000, rows[3][1])]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, class_id int")
    got = j.join(docs, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_stays_of_each_group(spark):
    rows = corpus(3, groups=12) + ODD
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, did int")
    out = j.deduplicated(docs)
    assert out.columns == docs.columns
    want = {(c, d) for d, c, _ in brute(rows)}
    kept = sorted((x.doc_id for x in out.collect()), key=str)
    assert kept == sorted([None, None, *{c for c, _ in want if c is not None}], key=str)
    assert j.deduplicated(docs.limit(0)).count() == 0 and j.join(docs.limit(0)).count() == 0


def test_of_rows_with_one_id_the_same_one_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a", {"k": 1}), (7, text, "b", {"k": 2}), (7, text, "b", {"k": 2}), (7, text + " end", "c", {"k": 3}), (8, text, "d", {"k": 4}), (9, "other", None, None), (9, "other", None, None)]
    docs = spark.createDataFrame(rows * 40, "doc_id long, text string, row string, extra map<string,int>")
    first = sorted(map(str, j.deduplicated(docs).collect()))
    assert len(first) == 2 and first == sorted(map(str, j.deduplicated(docs.orderBy(F.desc("row")).repartition(5)).collect()))


def test_depth_follows_from_the_data(spark):
    """A large cluster is a leaf at once; nodes of records that differ split until they are small."""
    rng = np.random.default_rng(4)
    near = np.repeat(rng.integers(0, 2**32, (1, 128), dtype=np.uint64), 300, 0)
    near[rng.random(near.shape) < 0.05] = 1
    half = rng.integers(0, 2**32, (300, 128), dtype=np.uint64)
    half[rng.random(half.shape) < 0.5] = 2  # any two agree in a quarter of their tokens
    rows = [(i, i, 10, 1, t.astype(np.uint32).tobytes()) for i, t in enumerate(np.vstack([near, half]))]
    records = spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in rows], "did long, fp long, n long, size long, tokens binary")
    leaves, depth = j.leaves_of(records, 0.8, range(1, 12), 16, 128)
    found = {}
    for x in leaves.collect():
        found.setdefault(x.leaf, []).append((x.did, x.n, x.shingles))
    assert all(len(v) == n and w == 10 * n for v in found.values() for _, n, w in v)
    assert 3 <= depth <= 1 + np.log(600 / 16) / np.log(1 / 0.8)
    assert max(len(v) for v in found.values()) > 200
    assert all(min(len([d for d, _, _ in v if d < 300]), len([d for d, _, _ in v if d >= 300])) <= 16 for v in found.values() if len(v) > 100)


def test_runs_meet_the_target_recall():
    rng = np.random.default_rng(1)
    runs = j.runs_for(0.8, 4, 0.9999)
    assert j.losses(0.8, 4) ** runs <= 1e-4
    missed = 0
    for _ in range(300):  # pairs that agree in exactly four of five tokens
        a = rng.integers(0, 2**32, 125, dtype=np.uint64).astype(np.uint32)
        b = a.copy()
        b[rng.permutation(125)[:25]] ^= 1
        nodes = [np.arange(1, runs + 1, dtype=np.uint64)] * 2
        for _ in range(4):
            nodes = [j.children(p, np.repeat(t[None], len(p), 0), 0.8)[1] for p, t in zip(nodes, (a, b))]
            nodes = [np.intersect1d(*nodes)] * 2
        missed += not len(nodes[0])
    assert missed <= 2


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("struct(id as did, 0 as fp) as x", "struct(id + 1 as did, 0 as fp) as y").union(spark.range(1000, 1003).selectExpr("struct(id as did, 0 as fp) as x", "struct(id + 1 as did, 0 as fp) as y"))
    got = {x.node.did: x.root.did for x in j.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1004)}}


def test_confirm_agrees_with_sets():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(50)], np.uint64)) for _ in range(30)]
    pairs = np.triu(np.ones((30, 30), bool), 1)
    few = np.zeros_like(pairs)
    few[0, 1:9] = True
    want = np.array([[a < b and len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b])) for b in range(30)] for a in range(30)])
    assert (j.confirm(sets, pairs, 0.5) == want).all() and (j.confirm(sets, few, 0.5) == (want & few)).all()


def test_runs_meet_the_target_recall_over_drawn_agreement():
    runs = j.runs_for(0.8, 4, 0.9999)
    rng = np.random.default_rng(3)
    share = rng.binomial(128, 0.8, 20_000) / 128
    chances = {x: j.losses(0.8, 4, x) ** runs for x in set(share.tolist())}
    assert np.mean([chances[x] for x in share.tolist()]) <= 1.2e-4
    assert j.missed(0.8, 4, runs, 128) <= 1e-4 < j.missed(0.8, 4, runs - 1, 128)
    with pytest.raises(ValueError):
        j.runs_for(0.8, 4, 0.9999, tokens=4)
    # few tokens spread widely; the agreement of each pair is drawn, then its trees are walked
    few, recall, missed = 32, 0.95, 0
    runs = j.runs_for(0.8, 4, recall, tokens=few)
    for _ in range(2000):
        a = rng.integers(0, 2**32, few, dtype=np.uint64).astype(np.uint32)
        b = a ^ (rng.random(few) >= 0.8).astype(np.uint32)
        nodes = [np.arange(1, runs + 1, dtype=np.uint64)] * 2
        for _ in range(4):
            nodes = [j.children(p, np.repeat(t[None], len(p), 0), 0.8)[1] for p, t in zip(nodes, (a, b))]
            nodes = [np.intersect1d(*nodes)] * 2
        missed += not len(nodes[0])
    assert missed <= 2000 * (1 - recall) + 40
