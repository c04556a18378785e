"""Pairs that are never listed, against the same pairs listed."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as e
from simloom.operators import candidates, matching
from simloom.operators.scoredpairs import ScoredPairs


def sides(spark, n, m, dims=3, seed=4):
    rng = np.random.default_rng(seed)
    made = []
    for size in (n, m):
        x = np.round(rng.standard_normal((size, dims)), 1)
        x[0] = 0  # a zero vector is at 0 to all
        if size > 3:
            x[1] = x[2]  # copies
        made.append(spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)], "nid long, emb array<double>"))
    return made


def listed(u, v, threshold):
    return candidates.rescore(candidates.cosine_pairs(u, v, threshold).select("u", "v", "cos")).select("u", "v", "score")


def test_scores_are_those_of_listed_pairs(spark):
    for n, m, threshold in ((40, 30, 0.0), (2, 1, 0.999)):
        u, v = sides(spark, n, m)
        want = {(x.u, x.v): x.score for x in listed(u, v, threshold).collect()}
        pairs = ScoredPairs(u, v, threshold, chunk=7)
        for by in ("u", "v") if want else ():
            got = {(x.u, x.v): x.score for x in pairs.best(by, 50).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
            few = matching._best(pairs.best(by, 3), by, "value", 3).collect()
            for node in {getattr(x, by) for x in few}:
                best = sorted((s for (a, b), s in want.items() if (a if by == "u" else b) == node), reverse=True)[:3]
                assert np.allclose(sorted((x.score for x in few if getattr(x, by) == node), reverse=True), best, atol=2e-9)
        assert pairs.bounds()[:2] == (len({k[0] for k in want}), len({k[1] for k in want}))


def test_matching_is_as_good_as_that_of_listed_pairs(spark):
    u, v = sides(spark, 20, 12)
    rows = listed(u, v, -1.0).toPandas()
    weight = rows.pivot(index="v", columns="u", values="score").to_numpy()
    want = weight[np.arange(12), matching.assign(weight)].sum()
    got = matching.mwm(ScoredPairs(u, v, -1.0, chunk=7), 100, a_round=1).collect()
    assert len(got) == len({x.u for x in got}) == len({x.v for x in got}) == 12
    assert abs(sum(x.score for x in got) - want) < 1e-8


def test_no_pair_is_no_match(spark):
    u, v = sides(spark, 2, 2)
    assert matching.mwm(ScoredPairs(u.withColumn("emb", F.array(F.lit(1.0))), v.withColumn("emb", F.array(F.lit(-1.0))), 0.5), 5).collect() == []


def test_match_mwm_lists_no_pairs(spark, sf, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("half of all pairs were listed")

    monkeypatch.setattr(candidates, "cosine_pairs", refused)
    assert e.queries()["match_mwm"](spark, sf).count() == 100
