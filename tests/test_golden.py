"""Hand-derived fixtures (FIXTURES.md, part 4) and properties on small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import bloom, estimators, text
from simloom.functions.murmur import murmur3
from simloom.operators import blocking, candidates, evaluate, graph, graphwave, matching, neural, prepare, scaling, simjoin


def murmur(data, seed):
    m = 0xFFFFFFFF
    turn = lambda x, k: (x << k | x >> 32 - k) & m
    mix = lambda k: turn(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h, full = seed, len(data) // 4 * 4
    for i in range(0, full, 4):
        h = (turn(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & m
    if data[full:]:
        h ^= mix(int.from_bytes(data[full:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_bigrams(spark):
    rows = spark.createDataFrame([("peter", "x"), ("pete", ""), ("", None), ("a", "b")], "s string, t string")
    got = rows.select(text.bigrams("s").alias("g"), text.bigrams("s", padding=True).alias("p"), text.bigrams("s", "t").alias("b")).collect()
    assert [x.g for x in got] == [["er", "et", "pe", "te"], ["et", "pe", "te"], [], []]
    assert [len(x.p) for x in got] == [6, 5, 1, 2] and got[2].p == ["__"] and got[3].p == ["_a", "a_"]
    assert [x.b for x in got] == [x.g for x in got]  # none spans two attributes
    pair = spark.createDataFrame([(got[0].g, got[1].g)], "a array<string>, b array<string>")
    assert pair.select(estimators.dice(F.col("a"), F.col("b"))).first()[0] == 6 / 7


def test_murmur(spark):
    grams = ["ab", "a", "é", "éü", "日本", "a日", "😀😀", "x😀", ""]
    rows = spark.createDataFrame([(g, s) for g in grams for s in range(3)], "g string, s int")
    for x in rows.withColumn("h", murmur3(F.col("g"), F.col("s"))).collect():
        assert x.h == murmur(x.g.encode(), x.s)
    assert [murmur(b"ab", s) for s in range(3)] == [-1681926305, -1207461050, 1752756981]


def test_filter_codec(spark):
    rows = spark.createDataFrame([(1, "AYA=")], "row_idx long, b string").select("row_idx", *bloom.decode(F.col("b"), 64))
    assert sorted(x.pos for x in bloom.set_positions(rows, length=64).collect()) == [0, 15]
    assert rows.select(bloom.encode(64)).first()[0] == "AYAAAAAAAAA="


def test_estimators(spark):
    e = estimators
    lit = lambda x: F.lit(x)
    got = spark.range(1).select(
        e.qgram_estimate(lit(60), 1024, 10), e.qgram_estimate(lit(70), 1024, 10), e.common_estimate(lit(60), lit(70), lit(100), 1024, 10), e.adjusted_dice(lit(60), lit(70), lit(100), 1024, 10), e.adjusted_dice(lit(1024), lit(70), lit(1024), 1024, 10), e.adjusted_dice(lit(0), lit(0), lit(0), 1024, 10)
    ).first()
    assert [round(x, 6) for x in got] == [6.182964, 7.250753, 2.911121, 0.433405, 0.0, 0.0]
    bits, plain = spark.createDataFrame([(120,)], "bits int"), spark.createDataFrame([(["x"] * 12,), (["x"] * 13,)], "grams array<string>")
    assert e.hash_count(bits, "bits", plain, "grams", 1024) == 10


GRAPH = [(1, 2, 0.5), (1, 3, 0.6), (2, 3, 0.7), (3, 4, 0.8), (4, 5, 0.9)]


def test_node_features(spark):
    edges = spark.createDataFrame(GRAPH, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, float(i), 2) for i in range(1, 6)], "nid long, qgrams_count double, node_count long")
    rows = {x.nid: x.features for x in graph.node_features(edges, nodes, "all", 4, node_count=True).collect()}
    c = rows[3]
    assert np.allclose(c[:10], [3, 3, 0.8, 0.6, 0.7, 0.0816496581, 4, 2 / 3, 4 / 6, 0.75])
    assert c[10:] == [0, 4, 0, 1, 4, 0, 2]
    assert abs(rows[4][8] - 0.5) < 1e-12
    with pytest.raises(ValueError):
        graph.node_features(edges, nodes, "none")
    with pytest.raises(ValueError):
        graph.betweenness(edges, most_edges=2)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0), (3, 2, 1.0), (7, 7, 1.0)], "src long, dst long, weight double")
    assert sorted((x.src, x.dst) for x in graph.create_graph(edges, 3).collect()) == [(1, 2), (2, 3)]
    assert {x.nid: x.comp for x in graph.components(edges.where("src <> dst")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_rescoring(spark):
    pairs = spark.createDataFrame([(0, 0, 0.95), (0, 1, 0.92), (1, 1, 0.97)], "u long, v long, cos double")
    got = {(x.u, x.v): x for x in candidates.rescore(pairs).collect()}
    assert np.allclose([got[k].sim_conf for k in ((0, 0), (0, 1), (1, 1))], [1.032609, 0.958333, 1.054348], atol=1e-6)
    assert np.allclose([got[k].score for k in ((0, 0), (0, 1), (1, 1))], [0.692075, 0, 1], atol=1e-6)
    assert [(x.u, x.v) for x in matching.shm(candidates.rescore(pairs)).collect()] == [(1, 1), (0, 0)]
    alone = pairs.where("u = 1")
    x = candidates.rescore(alone).first()
    assert (x.sim_conf, x.degree_conf, x.score) == (1.5, 1.0, 0.0)
    assert candidates.rescore(alone, strict=True).first().score is None


def test_rescoring_is_the_same_whether_sums_are_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    pairs = spark.createDataFrame([(i, j, rng.random()) for i in range(20) for j in range(20) if rng.random() < 0.4], "u long, v long, cos double")
    found = []
    for limit in (500_000, 0):
        monkeypatch.setattr(candidates, "BROADCAST_NODES", limit)
        rows = candidates.rescore(pairs)
        found.append((sorted((x.u, x.v, round(x.score, 9)) for x in rows.collect()), [(x.u, x.v) for x in matching.shm(rows).collect()]))
    assert found[0] == found[1] and len(found[0][0]) == pairs.count() and found[0][1]


def match(spark, rows, how):
    return sorted((x.u, x.v) for x in matching.match(spark.createDataFrame(rows, "u long, v long, score double"), how).collect())


def test_matchers(spark):
    rows = [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85)]
    assert [match(spark, rows, m) for m in ("shm", "smm", "mwm")] == [[(0, 0)], [(0, 0)], [(0, 1), (1, 0)]]
    assert match(spark, [rows[0], rows[2]], "mwm") == [(0, 0)]
    assert match(spark, [(0, 0, 0.9), (1, 0, 0.8), (2, 1, 0.7), (2, 2, 0.6)], "mwm") == []
    with pytest.raises(ValueError):
        match(spark, rows, "none")


def test_assignment_is_the_best_full_one():
    rng = random.Random(1)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        w = np.array([[rng.choice([-math.inf, rng.randint(1, 9), rng.random()]) for _ in range(m)] for _ in range(n)])
        best = max((sum(w[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)), default=-math.inf)
        if best == -math.inf:
            with pytest.raises(ValueError):
                matching.assign(w)
        else:
            found = matching.assign(w)
            assert len(set(found)) == n and abs(sum(w[i, j] for i, j in enumerate(found)) - best) < 1e-9


def test_a_cover_goes_on_from_one_of_fewer_cells():
    rng = np.random.default_rng(3)
    for trial in range(400):
        n, m = rng.integers(1, 9, 2)
        w = np.where(rng.random((n, m)) < rng.choice([0.3, 0.6, 1.0]), np.round(rng.random((n, m)), rng.integers(1, 4)), -np.inf)
        alone, known = matching.loss_of_none(int(n), 1.0) if trial % 2 else 0.3, None
        for share in (0.3, 0.6, 1.0):
            i, j = np.nonzero(np.isfinite(w) & (rng.random((n, m)) < share) if share < 1 else np.isfinite(w))
            if known:
                i, j = np.array(sorted({*zip(i.tolist(), j.tolist())} | cells), int).reshape(-1, 2).T
            cells = {*zip(i.tolist(), j.tolist())}
            mate, a, b = known = matching.cover(n, m, i, j, w[i, j], alone, known)
            cold = matching.cover(n, m, i, j, w[i, j], alone)[0]
            total = lambda mate: sum(-alone if y < 0 else w[x, y] for x, y in enumerate(mate))
            assert abs(total(mate) - total(cold)) < 1e-9 and len({*mate[mate >= 0].tolist()}) == (mate >= 0).sum()
            assert all(a[x] + b[y] <= -w[x, y] + 1e-9 for x, y in cells) and (b <= 1e-9).all() and (a <= alone + 1e-9).all()
            assert abs(a.sum() + b.sum() + total(mate)) < 1e-8  # the prices prove the total


def test_a_component_of_any_size_is_matched(spark):
    n = 5_100  # 26 million cells; v 0 has u 0 only, so that all go straight, against the better pairs
    straight = spark.range(n).select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.5).alias("score"))
    rows = straight.unionAll(spark.range(n - 1).select(F.col("id"), F.col("id") + 1, F.lit(0.9)))
    assert [(x.u, x.v) for x in matching.mwm(rows, n).collect()] == [(i, i) for i in range(n)]


def test_matching_takes_up_every_pair_that_can_raise_it(spark):
    rng = random.Random(5)
    for n, m, share in ((6, 6, 1.0), (7, 5, 0.9), (5, 7, 0.7), (6, 6, 0.35)):
        w = {(i, j): round(rng.random(), 3) for i in range(n) for j in range(m) if rng.random() < share}
        us, vs = ([*{x[k] for x in w}] for k in (0, 1))
        small, large, at = (us, vs, lambda i, j: w.get((i, j), -math.inf)) if len(us) <= len(vs) else (vs, us, lambda j, i: w.get((i, j), -math.inf))
        best = max(sum(at(*x) for x in zip(small, p)) for p in itertools.permutations(large, len(small)))
        pairs = spark.createDataFrame([(*x, s) for x, s in w.items()], "u long, v long, score double")
        found = matching.mwm(pairs, 100, a_round=1).collect()
        assert len({x.u for x in found}) == len({x.v for x in found}) == len(found) == (0 if best == -math.inf else len(small))
        assert not found or abs(sum(x.score for x in found) - best) < 1e-9


def test_smm_has_no_blocking_pair(spark):
    rng = random.Random(2)
    rows = [(u, v, rng.randint(1, 5) / 5) for u in range(8) for v in range(8) if rng.random() < 0.5]
    found = match(spark, rows, "smm")
    order = {(u, v): (-s, u, v) for u, v, s in rows}
    of_u, of_v = dict(found), {v: u for u, v in found}
    assert len(of_u) == len(found) == len(of_v)
    for u, v, _ in rows:
        better = lambda other: other is None or order[u, v] < order[other]
        assert not (better((u, of_u[u]) if u in of_u else None) and better((of_v[v], v) if v in of_v else None)) or (u, v) in found


def test_precision(spark):
    truth = spark.createDataFrame([("a", "A"), ("c", "C")], "u_key string, v_key string")
    matches = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "c", "C")], "rank int, u_key string, v_key string")
    assert [x.precision for x in evaluate.precision_at(matches, truth, (1, 2, 10)).collect()] == [1.0, 0.5, 0.2]
    assert math.isnan(evaluate.precision_at(matches.limit(0), truth, (1,)).first().precision)
    assert evaluate.true_matches(matches, truth).first().tp == 2


def test_scalers(spark):
    rows = spark.createDataFrame([(i, [float(i), 7.0]) for i in (1, 2, 3)], "nid long, features array<double>")
    got = {x.nid: x.features for x in scaling.scale(rows, "standard").collect()}
    assert np.allclose([got[i][0] for i in (1, 2, 3)], [-1.224745, 0, 1.224745], atol=1e-6) and got[2][1] == 0
    assert {x.nid: x.features for x in scaling.scale(rows, "minmax").collect()} == {1: [0, 0], 2: [0.5, 0], 3: [1, 0]}


def ring(n, rng):
    src = np.concatenate([np.arange(n), rng.integers(0, n, n)])
    dst = np.concatenate([(np.arange(n) + 1) % n, rng.integers(0, n, n)])
    keep = src != dst
    pairs = np.unique(np.sort(np.stack([src[keep], dst[keep]], 1), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def test_graphwave_agrees_with_eigenvectors(spark):
    assert np.allclose(graphwave.auto_scales(64), [0.290159, 1.262291], atol=1e-6)
    rng = np.random.default_rng(1)
    src, dst = ring(24, rng)
    weight = rng.random(len(src)) + 0.1
    matrix = graphwave.laplacian_less_one(src, dst, weight, 24)
    dense = np.eye(24)
    np.add.at(dense, (matrix[0], matrix[1]), matrix[2])
    values, vectors = np.linalg.eigh(dense)
    exact = (vectors * np.exp(-1.3 * values)) @ vectors.T
    got = graphwave.heat_columns(matrix, 24, np.arange(24), [1.3], 30)[0]
    assert np.abs(np.where(exact > 1e-4 / 24, exact, 0) - got).max() < 1e-4 / 20
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(src, dst, weight)], "src long, dst long, weight double")
    one, many = ({x.nid: x.emb for x in graphwave.graphwave(edges, batch=b).collect()} for b in (5, 64))
    assert len(one) == 24 and len(one[0]) == 200 and all(np.allclose(one[k], many[k]) for k in one)


def test_trainers_learn_and_repeat():
    rng = np.random.default_rng(2)
    src, dst = ring(60, rng)
    x = rng.standard_normal((60, 6))
    emb, losses = neural.train_sage(x, src, dst, layers=(16, 8), epochs=15, batch=64)
    assert emb.shape == (60, 8) and np.allclose((emb**2).sum(1), 1) and np.mean(losses[-10:]) < np.mean(losses[:10])
    assert np.array_equal(emb, neural.train_sage(x, src, dst, layers=(16, 8), epochs=15, batch=64)[0])
    emb, losses = neural.train_dgi(x, src, dst, width=8, epochs=60)
    assert emb.shape == (60, 8) and np.mean(losses[-5:]) < np.mean(losses[:5])


def test_joins_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    records = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_idx long, w string")
    u = prepare.plain_nodes(records, ["w"])
    every = {(x.src, x.dst): x.weight for x in simjoin.plain_edges(u, 0.0).collect()}
    n = u.count()
    assert len(every) == n * (n - 1) // 2
    for t in (0.4, 0.75, 1.0):
        assert {(x.src, x.dst): x.weight for x in simjoin.plain_edges(u, t).collect()} == {k: w for k, w in every.items() if w >= t}
    v = prepare.encoded_nodes(prepare.encode_records(records, ["w"], 4, 128), "base64_bf", 128, 4)
    flat = {(x.src, x.dst): x.weight for x in simjoin.encoded_edges(v, 0.0, 128, 4).collect()}
    got = {(x.src, x.dst): x.weight for x in simjoin.encoded_edges(v, 0.6, 128, 4, cell=7).collect()}
    assert got == {k: w for k, w in flat.items() if w >= 0.6}
    keys = blocking.block_keys(v.select("nid", *bloom.word_names(128)), blocking.choose_positions(3, 4, 128, 1), blocking.word_bit())
    assert set(got) >= {(x.src, x.dst) for x in simjoin.encoded_edges(v, 0.6, 128, 4, keys).collect()}
    assert prepare.ground_truth(u, v).count() > 0


def slope_error(loss, w):
    """The largest difference between the gradient and central differences."""
    found, worst = loss(w)[1], 0.0
    for a, g in zip(w, found):
        for i in np.ndindex(a.shape):
            at = a[i]
            a[i] = at + 1e-6
            up = loss(w)[0]
            a[i] = at - 1e-6
            down = loss(w)[0]
            a[i] = at
            worst = max(worst, abs((up - down) / 2e-6 - g[i]))
    return worst


@pytest.mark.parametrize("layers,samples", [((5,), (3,)), ((6, 4), (3, 2)), ((6, 5, 3), (2, 2, 2))])
def test_gradient_of_graphsage(layers, samples):
    rng = np.random.default_rng(1)
    src, dst = ring(9, rng)
    adj, x = neural._Adjacency(src, dst, 9), rng.normal(size=(9, 4))
    w = [a + rng.normal(size=a.shape) * 0.1 for a in neural.sage_weights(rng, 4, layers)]
    ends = tuple(neural._levels(adj, rng, rng.integers(0, 9, 6), samples) for _ in range(2))
    assert slope_error(lambda w: neural.sage_loss(w, x, ends, np.array([1, 0, 1, 1, 0, 0.0]), samples), w) < 1e-6


@pytest.mark.parametrize("activations", [("relu",), ("tanh", "relu"), ("elu", "sigmoid", "softplus"), ("linear",)])
def test_gradient_of_deep_graph_infomax(activations):
    rng = np.random.default_rng(2)
    src, dst = ring(9, rng)
    adj, x, w, width = neural._Adjacency(src, dst, 9), rng.normal(size=(9, 4)), [], 4
    for h in (5, 4, 3)[: len(activations)]:
        w += [rng.normal(size=(width, h)), rng.normal(size=h)]
        width = h
    w.append(rng.normal(size=(width, width)))
    shuffled = x[rng.permutation(9)]
    assert slope_error(lambda w: neural.dgi_loss(w, adj, x, shuffled, activations), w) < 1e-6
    with pytest.raises(ValueError):
        neural.train_dgi(x, src, dst, layers=(4, 4), activations=("relu",))
    with pytest.raises(ValueError):
        neural.train_dgi(x, src, dst, layers=(4,), activations=("swirl",))
    emb, _ = neural.train_dgi(x, src, dst, layers=(4, 3), activations=("elu", "tanh"), epochs=3)
    assert emb.shape == (9, 3) and np.abs(emb).max() <= 1
