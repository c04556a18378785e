import random
import zlib

import numpy as np

from simloom.llm import toxicity as t


def corpus(n=1500):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(40)] + (rng.sample(["vile", "scum", "idiot"], 2) if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in t.op5_toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (r in held) for r in rows[:200])
    assert np.mean([got[r[0]].predicted == r[2] for r in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    # labels and texts of the held-out rows change nothing
    ids = {r[0] for r in held}
    flipped = spark.createDataFrame([(i, 1 - y if i in ids else y) for i, y in labels], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, "scum " * 5 if i in ids else x) for i, x, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert t.train(docs, known) == t.train(other, flipped)


def test_odd_rows_and_empty_tables(spark):
    rows, labels = corpus(400)
    extra = [(None, "scum vile idiot", 0), (1, None, 0), (2, "", 0), (5, rows[5][1], 0), (5, rows[5][1], 0), (9, "vile scum " * 100_000, 0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, label int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = t.op5_toxicity(docs, known).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= x.score <= 1 for x in out)
    assert t.op5_toxicity(docs, known.limit(0)).agg({"predicted": "max"}).first()[0] == 0
    assert t.op5_toxicity(docs.limit(0), known).count() == 0
    kept = t.clean(docs, known)
    assert kept.columns == docs.columns and kept.where("text = 'scum vile idiot'").count() == 0


def test_the_risk_corrects_for_positives_in_the_unlabelled():
    rng = np.random.default_rng(1)
    p = [np.array([1, 2]) if rng.random() < 0.9 else np.array([2]) for _ in range(400)]
    u = [np.array([1, 2]) if rng.random() < 0.36 else np.array([2]) for _ in range(2000)]
    model = t.fit(p, u, 0.4, sure=0)
    assert 1 / (1 + np.exp(-(model.bias + model.weights[1] + model.weights.get(2, 0)))) > 0.9  # the share of positives among those with word 1
    assert 1 / (1 + np.exp(-(model.bias + model.weights.get(2, 0)))) < 0.3


def brute_risk(w, b, positive, unlabelled, prior):
    """Both parts of the risk from the definition, document by document."""
    loss = lambda x: np.log1p(np.exp(-x))
    f = lambda doc: b + sum(w[i] for i in doc)
    plus = prior * np.mean([loss(f(x)) for x in positive])
    return plus, np.mean([loss(-f(x)) for x in unlabelled]) - prior * np.mean([loss(-f(x)) for x in positive])


def test_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    words, seen = np.arange(6), set()
    for trial in range(40):
        positive = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(9)]
        unlabelled = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(14)]
        p, u = t._Rows(positive, words), t._Rows(unlabelled, words)
        w, b, prior = rng.normal(0, 2, 6), rng.normal(0, 3), 0.6
        of = lambda w, b: brute_risk(w, b, positive, unlabelled, prior)
        plus, minus, g = t.risk(w, b, p, np.arange(9), u, np.arange(14), prior)
        assert np.allclose((plus, minus), of(w, b))
        seen.add(minus < 0)
        part = (lambda w, b: sum(of(w, b))) if minus >= 0 else (lambda w, b: -of(w, b)[1])  # below zero the step is against that part alone
        for k in range(7):
            e = np.eye(7)[k] * 1e-5
            slope = (part(w + e[:6], b + e[6]) - part(w - e[:6], b - e[6])) / 2e-5
            assert abs(slope - g[k]) < 1e-6
    assert seen == {True, False}


def test_counts_and_chosen_words_equal_brute_force(spark, monkeypatch):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    sure = {i for i, y in labels if y and zlib.crc32(str(i).encode()) % 5}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    got = {x.word: (x.p, x.u) for x in t.word_counts(docs.select("doc_id", "text").where(t.fold() != 0), frozenset(sure)).collect()}
    assert got.pop(None) == (len(sure), len(train))
    words = {r[0]: t.word_ids(r[1]) for r in train}
    assert got == {w: (sum(w in words[i] for i in sure), sum(w in x for x in words.values())) for w in set().union(*words.values())}
    seen = []
    monkeypatch.setattr(t, "fit", lambda p, u, prior, words: seen.append((p, u, words)))
    t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    (p, u, chosen), = seen
    lists = lambda ids: [np.array(sorted(words[i]), np.int64) for i in ids]
    assert chosen.tolist() == t.screen(lists(sorted(sure)), lists(sorted(words)), 3, 4096, 5.0).tolist()
    assert [x.tolist() for x in p] == [sorted(words[i] & set(chosen.tolist())) for i in sorted(sure)] and len(u) == len(train)


def test_the_sample_is_bounded_by_ids(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows * 5, "doc_id long, text string, lang int")
    assert len(t._sample(docs.select("doc_id", "text"), np.array([], np.int64))) == 300


def test_counts_leave_a_task_early(spark):
    """A task holds few words, whatever its batches hold, and rows of counts go out in slices."""
    rows = [(i, " ".join(f"w{(i * 37 + k) % 60_000}" for k in range(200))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.word: (x.p, x.u) for x in t.word_counts(frame, frozenset(range(0, 2000, 3)), counted=500).collect()}
    want = {}
    for i, text in rows:
        for w in [*t.word_ids(text), None]:
            p, u = want.get(w, (0, 0))
            want[w] = (p + (i % 3 == 0), u + 1)
    assert found == want

    class Plan:  # hands the task's function to this process
        sparkSession = spark

        def mapInArrow(self, run, schema):
            batch = t.pa.RecordBatch.from_arrays([t.pa.array([x[0] for x in rows]), t.pa.array([x[1] for x in rows])], names=["doc_id", "text"])
            self.sizes = [x.num_rows for x in run(iter([batch]))]
            return frame.selectExpr("1L AS word", "1L AS p", "1L AS u")

    plan = Plan()
    t.word_counts(plan, frozenset(), counted=500)
    assert max(plan.sizes) <= 500 + 201
    many = Plan()
    t.word_counts(many, frozenset(), counted=10**9)
    assert max(many.sizes) <= 16_384 < sum(many.sizes)
