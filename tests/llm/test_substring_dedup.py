import random
import re

import numpy as np
import pytest

from simloom.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    big = 2**63 - 1
    at = lambda d: big if d is None else d
    least = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, big), at(d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < at(d):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    out = [(None, " ".join(passage)), (4, None), (5, ""), (6, "a b"), (7, " ".join(passage[:12])), (8, "\t".join(passage[:13])), (9, "x" * 100_000 + " é" * 30)]
    for d in range(20, 60):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 80))]
        a = rng.randint(0, 50)
        w[rng.randint(0, len(w)) : 0] = passage[a : a + rng.randint(5, 40)]
        out.append((d, rng.choice([" ", "\n", " \r\n "]).join(w)))
    out += [(30, out[-1][1]), (30, out[-1][1]), (61, out[-2][1]), (62, "é " * 40), (63, "a " * 40), (64, "a " * 30)]
    return out


@pytest.mark.parametrize("blocks", [1, 12])
def test_equals_brute_force(spark, blocks):
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows())], "doc_id long, text string, block int")
    out = sd.dedup_windows(docs, blocks=blocks).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out), key=str) == brute(rows())
    for x in out:
        assert sum(r["to"] - r["from"] for r in x.removed) == x.n_removed
        assert all(a["to"] < b["from"] for a, b in zip(x.removed, x.removed[1:]))


def test_hot_ids_are_split(spark):
    docs = [(7, f"{i} " + "one two three four five six seven eight nine ten eleven twelve thirteen") for i in range(300)]
    docs += [(i, docs[0][1]) for i in (1, 9)]
    out = sd.dedup_windows(spark.createDataFrame(docs, "doc_id long, text string"), blocks=10).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out) == brute(docs)


def test_empty_table_and_codec(spark):
    assert sd.dedup_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (sd.unpack_keys(sd.pack_keys(keys)) == keys).all()


@pytest.mark.parametrize("ids", ["half", "all", "ends"])
@pytest.mark.parametrize("blocks", [1, 7])
def test_many_null_and_extreme_ids(spark, ids, blocks):
    pick = {"half": lambda i: i if i % 2 else None, "all": lambda i: None, "ends": lambda i: (-(2**63), -(2**63) + 1, 2**63 - 2, 2**63 - 1, 0, None)[i % 6]}[ids]
    words = [f"w{i}" for i in range(40)]
    docs = [(pick(i), " ".join(words[i % 9 : 20 + i % 9] + [f"own{i // 2}"] * 3 + words[i % 4 : 15 + i % 4])) for i in range(40)]
    out = sd.dedup_windows(spark.createDataFrame(docs, "doc_id long, text string"), blocks=blocks).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out), key=str) == brute(docs)


def test_places_ascend_and_are_of_bounded_size():
    """Dense and sparse ids, hot ones, an outlier, rows without ids: bins are cut until none is too large."""
    rng = np.random.default_rng(2)
    big = 2**63 - 1
    ids = np.sort(np.concatenate([rng.integers(0, 1000, 500), rng.integers(10**15, 10**15 + 4000, 3000), np.full(400, 77_000), [-(2**63), big - 1], np.full(300, big)]))
    ends, new, passes = [big - 1, big], True, 0
    while new:
        bins, passes = [], passes + 1
        for low, end in zip([-(2**63) - 1, *ends], ends):
            own = ids[(ids > low) & (ids <= end)]
            if len(own):
                bins.append((end, int(own[0]), int(own[-1]), 10 * len(own), [int(own[min(len(own) - 1, len(own) * k // 8)]) for k in range(1, 8)]))
        ends, new = sd.refined(bins, 600)
        ends = sorted({*ends, big - 1, big})
    assert passes < 8
    block = sd.Places([b[:4] for b in bins], 600).blocks(ids, rng.integers(0, 1 << 20, len(ids)))
    rank = block >> 20
    assert (np.diff(rank) >= 0).all()
    assert len(set(rank[ids == 77_000])) == 1 and len(set(block[ids == 77_000])) > 3
    assert len(set(rank[ids == big])) == 1 and rank[ids == big][0] > rank[ids == big - 1][0]
    counts = np.unique(block, return_counts=True)[1]
    assert counts.max() <= 2 * 60
    for x in (77_000, big):  # only blocks of one id share a rank
        assert set(ids[np.isin(rank, rank[ids == x])]) == {x}
