import hashlib

import pytest

from simloom.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    big = 2**63 - 1
    at = lambda d: big if d is None else d
    keys = lambda t: [x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")]
    owner, holders = {}, {}
    for d, t in rows:
        for k in keys(t):
            owner[k] = min(owner.get(k, big), at(d))
            holders.setdefault(k, set()).add(at(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if len(k) < 10 or len(holders[k]) < 2 or owner[k] == at(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (5, "A common line here\nown one of five\n\nA common line here"),
    (2, "  a COMMON line here\t\nshort\nother"),
    (9, "a common line here"),
    (9, "a common line here"),
    (1, None),
    (3, ""),
    (None, "a common line here\nof no id at all"),
    (4, "short\nof no id at all\n" + "\n".join(f"line number {i} of many" for i in range(5000))),
    (7, "LINE NUMBER 17 of many\nÄhnliche Zeile\n"),
    (8, "line number 17 of many\n\x0cähnliche Zeile\nÄhnliche Zeile "),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_equals_brute_force(spark, batches, fanout):
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(ROWS)], "doc_id long, text string, pos int")
    out = ld.dedup_lines(docs, batches=batches, fanout=fanout)
    got = [(x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept.encode()).hexdigest()) for x in out.collect()]
    assert sorted(got, key=str) == brute(ROWS)
    assert ld.dedup_lines(docs.limit(0), batches=batches).count() == 0


def test_an_index_goes_on_and_compacts(spark):
    index = ld.LineIndex(spark, fanout=2, buckets=4)
    for i in range(3):
        docs = spark.createDataFrame([(i, f"the shared line\nthe line of {i} alone")], "doc_id long, text string")
        out = ld.dedup_lines(docs, batches=1, index=index).collect()[0]
        assert out.n_dropped == (i > 0)
    assert [len(x) for x in index.levels] == [1, 1]
    assert sum(x.count() for x in index.runs()) == 4
    index.drop()


def test_no_python_in_the_plan(spark, sf):
    out = ld.op2_line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("ids", ["half", "all", "ends"])
def test_many_null_and_extreme_ids(spark, ids):
    n = 40
    pick = {"half": lambda i: i if i % 2 else None, "all": lambda i: None, "ends": lambda i: (-(2**63), -(2**63) + 1, 2**63 - 2, 2**63 - 1, 0, None)[i % 6]}[ids]
    rows = [(pick(i), f"the line number {i % 7} of many\nshort\nthe line of {i // 2} alone") for i in range(n)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=4)
    got = [(x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept.encode()).hexdigest()) for x in out.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_tables_go_when_a_batch_fails(spark, monkeypatch):
    before = {x.name for x in spark.catalog.listTables()}
    monkeypatch.setattr(ld.LineIndex, "unseen", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ld.dedup_lines(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert {x.name for x in spark.catalog.listTables()} == before
