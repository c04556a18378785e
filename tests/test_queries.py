"""Queries on rows that the given tables don't hold."""

import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from simloom import queries as q
from simloom.operators import candidates


def star(spark, rays):
    """A node 0 with that many neighbours."""
    return spark.range(1, rays + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(0.7).alias("weight"))


@pytest.mark.parametrize("name,rays", [("histo_1hop", 5), ("histo_1hop", 300), ("histo_2hop", 300), ("features_all", 3), ("features_all", 20)])
def test_histograms_lose_no_member(spark, monkeypatch, name, rays):
    monkeypatch.setattr(q, "edges", lambda *_: star(spark, rays))
    monkeypatch.setattr(q, "plain", lambda *_: spark.range(rays + 1).select(F.col("id").alias("nid"), F.lit(9).alias("qgrams_count"), F.lit(1).alias("node_count")))
    by = {}
    for x in getattr(q, name)(spark, "").collect():
        by.setdefault(x.nid, {})[x.d] = x.x
    assert len(by) == rays + 1
    bins = max(3 if name == "features_all" else 8, rays.bit_length())
    for nid, row in by.items():
        ray, hub = (rays + 1, 1) if nid == 0 else (2, 1)  # members within one hop
        if name == "histo_2hop":
            ray = rays + 1
        own = [row[d] for d in sorted(row)]
        if name == "features_all":
            assert len(own) == 10 + 2 * bins and sum(own[10 + bins :]) == rays + 1
            own = own[10 : 10 + bins]
        assert len(own) == bins and sum(own) == ray and own[rays.bit_length() - 1] >= hub


@contextmanager
def within(spark, seconds):
    """Jobs still running after so long are cancelled, which raises."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


@pytest.mark.parametrize("name", ["true_matches", "precision_at_k"])
def test_a_large_class_is_not_listed_as_pairs(spark, monkeypatch, name):
    side = lambda first, n: spark.range(first, first + 2 * n, 2).select(F.col("id").alias("nid"), F.when(F.col("id") > 3, 7).otherwise(F.col("id") % 2).alias("label"))
    monkeypatch.setattr(q, "sides", lambda *_: (side(0, 200_000), side(1, 200_000)))
    monkeypatch.setattr(q, "scored", lambda *_: spark.createDataFrame([(0, 1, 0.9), (4, 5, 0.8), (6, 9, 0.7)], "u long, v long, score double"))
    with within(spark, 30):
        rows = getattr(q, name)(spark, "").collect()
    assert [x.tp for x in rows] == ([2] if name == "true_matches" else [0, 2, 2, 2, 2])


def test_long_vectors_are_normalised_in_one_pass(spark):
    rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.when(F.col("id") > 0, x).otherwise(0)).alias("emb"), "id")
    with within(spark, 30):
        sums = {x.id: x.s for x in rows.select("id", F.aggregate(candidates.normalised("emb"), F.lit(0.0), lambda a, v: a + v * v).alias("s")).collect()}
    assert sums[0] == 0.0 and all(abs(sums[k] - 1) < 1e-9 for k in range(1, 400))


def counted(spark, path):
    """A precision table that adds a line to a file whenever it is computed."""

    def run(batches):
        for batch in batches:
            with open(path, "a") as f:
                f.write("x\n" * len(batch))
            yield batch

    return spark.createDataFrame([(1, 1, 1.0)], "k long, tp long, precision double").mapInPandas(run, "k long, tp long, precision double")


def test_a_result_row_is_computed_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q, "precision_at_k", lambda *_: counted(spark, f"{tmp_path}/calls"))
    assert [x.precision_1 for x in q.result_sink(spark, "").collect()] == [1.0, 1.0]
    assert (tmp_path / "calls").read_text() == "x\n"


def test_result_rows_of_all_techniques_with_a_large_class(spark, monkeypatch):
    side = lambda first: spark.range(first, first + 400_000, 2).select(F.col("id").alias("nid"), F.lit(7).alias("label"))
    monkeypatch.setattr(q, "sides", lambda *_: (side(0), side(1)))
    monkeypatch.setattr(q, "scored", lambda *_: spark.createDataFrame([(4, 5, 0.8), (6, 9, 0.7)], "u long, v long, score double"))
    with within(spark, 60):
        rows = {x.technique: (x.precision_1, x.precision_5) for x in q.result_sink_techniques(spark, "").collect()}
    assert rows == {t: (1.0, 0.4) for t in q.TECHNIQUE_VALUES}
