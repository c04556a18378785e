import pytest

pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

import test_decontaminate
import test_jaccard_join
import test_mixing
import test_token_blocks

import corpus_pipeline as p
from simloom.llm import mixing, queries
from simloom.llm._common import stored


def test_each_stage_equals_its_brute_force_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {x.doc_id: x for x in docs.collect()}

    out = stored(p.toxicity(spark, docs, sf))
    rejected = {x.doc_id for x in queries.queries()["op5_toxicity"](spark, sf).collect() if x.predicted}
    assert out.columns == columns and {x.doc_id for x in out.collect()} == set(rows) - rejected

    kept = out.collect()
    out = stored(p.near_duplicates(spark, out, sf))
    want = {c for _, c, _ in test_jaccard_join.brute([(x.doc_id, x.text) for x in kept])}
    assert out.columns == columns and {x.doc_id for x in out.collect()} == want

    kept = out.collect()
    out = stored(p.decontamination(spark, out, sf))
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    few = [x for x in kept if len(x.text or "") < 1500]
    bad = {x.doc_id for x in few if test_decontaminate.brute(x.text, items)[4]}
    left = {x.doc_id for x in out.collect()}
    assert out.columns == columns and left <= {x.doc_id for x in kept}
    assert {x.doc_id for x in few} - left == bad

    kept = out.collect()
    test_mixing.check([(x.doc_id, x.text, x.source) for x in kept], mixing.mix(out).collect())
    out = stored(p.mixing(spark, out, sf))
    assert out.columns == columns

    got = sorted(tuple(x) for x in p.tokens(spark, out, sf).collect())
    assert got == sorted(test_token_blocks.brute([(x.doc_id, x.text) for x in out.collect()]))


ODD = [(None, None, None, None), (None, "", "en", "web"), (None, "no id but words " * 9, "en", "web"), (700_001, None, "en", "web"), (700_002, "same words in both of these rows " * 4, "de", None), (700_002, "same words in both of these rows " * 4, "de", None)]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_run_over_odd_tables(spark, sf, tmp_path, rows):
    """Nulls, repeated rows, a very long text, and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([*ODD, (700_003, "long " * 200_000, "en", "web")], docs.schema)
    docs = docs.unionByName(odd) if rows == "odd" else docs.limit(0)
    names = ["row", "did", "th", "key", "times", "score", "block", "copies", "rh", "own"]
    docs = docs.withColumns({x: F.lit(k % 3) for k, x in enumerate(names)}).withColumn("tags", F.create_map(F.lit("a"), F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    seen = []
    stages = [(n, lambda *a, f=f: seen.append(f(*a)) or seen[-1]) for n, f in p.STAGES]
    patch = pytest.MonkeyPatch()
    patch.setattr(p, "STAGES", stages)
    try:
        got = p.run(spark, str(tmp_path)).collect()
    finally:
        patch.undo()
    assert len(seen) == 5 and all(x.columns == docs.columns for x in seen[:4])
    got.sort(key=lambda x: x.start)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and (not got or got[0].start == 0)
    ids = [x.doc_id for x in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    if rows == "none":
        assert not got
    else:
        assert {700_003, None} < set(ids) | {None} and ids.count(700_002) <= 2
