import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from simloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 50, "a\na\n\n a\nb\nb", "é ü ß # $ <>|", "word " * 100_000]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "c "," ", "\n", "#", "é "]) for _ in range(rng.randint(0, 200))))
    return out


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, n_words int")
    got = {x.row.doc_id: tuple(x[1:6]) for x in q.measured(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}


def test_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 10, 200, 5000) for k in (0, 1, 3, 20, 90) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for x in got:
        exact = sum(math.comb(x.n, i) * 0.02**i * 0.98 ** (x.n - i) for i in range(x.k + 1))
        assert x.p == 1.0 if x.k >= x.n * 0.02 else abs(x.p - exact) < 1e-9 * max(exact, 1e-300) + 1e-12


def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(4000):
        good = rng.random() < 0.8
        words = ["w%d" % rng.randint(0, 9999) for _ in range(40)]
        text = " ".join(words if good else [w + "###" for w in words])
        rows.append((i, text, rng.choice(["en", "de"])))
        labels.append((i, int(good)))
    return rows, labels


def test_cutoffs_keep_the_promise(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(9000, None, None), (9001, rows[0][1], "xx"), (None, rows[0][1], "en"), (0, rows[0][1], "en")], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    by = {x.doc_id: x for x in q.judged(docs, known).collect()}
    good = [by[i].kept for i, y in labels if y]
    assert sum(good) >= 0.98 * len(good)
    assert not any(by[i].kept for i, y in labels if not y)
    assert by[9000].base_failed and not by[9000].kept and by[9001].kept
    assert len(q.op7_quality_rules(docs, known).collect()) == len(rows) + 4


def test_empty_tables_and_no_python(spark, sf):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:50], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert q.op7_quality_rules(docs.limit(0), known).count() == 0
    assert all(x.kept != x.base_failed for x in q.op7_quality_rules(docs, known.limit(0)).collect())
    plan = q.op7_quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_the_risk_is_that_of_all_measures_together(spark):
    for share, strict in ((600, False), (120, True)):  # of 40,000 good documents each measure has its own
        bad = [F.when((F.col("id") >= i * share) & (F.col("id") < (i + 1) * share), 0.5).otherwise(0.0).alias(m) for i, m in enumerate(q.MEASURES)]
        holdout = spark.range(40_000).select(F.lit("en").alias("stratum"), F.lit(1).alias("quality"), *bad)
        found = q.cutoffs(holdout).collect()
        cut = {m: getattr(found[0], f"max_{m}") if found else None for m in q.MEASURES}
        gone = sum(share for m in q.MEASURES if cut[m] is not None and cut[m] < 0.5)
        assert gone <= 0.02 * 40_000
        assert not strict or set(cut.values()) == {0.0}


def log_tail(k, n, p):
    """log P(X <= k) of a binomial(n, p), from exact terms."""
    if k >= n * p:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def brute_cutoffs(rows, risk=0.02, level=0.05):
    """stratum -> cutoffs by the definition. rows: (stratum, quality, measures)."""
    good = {}
    for stratum, quality, x in rows:
        if quality == 1:
            good.setdefault(stratum, []).append(x)
    tests = len(good) * (len(q.GRID) + 1) ** len(q.MEASURES)
    out = {}
    for stratum, xs in good.items():
        own = []
        for m in range(len(q.MEASURES)):
            fine = [c for c in q.GRID if log_tail(len(q.MEASURES) * sum(x[m] > c for x in xs), len(xs), risk) <= math.log(level / tests)]
            own.append(min(fine, default=None))
        if any(c is not None for c in own):
            out[stratum] = own
    return out


def drawn(rng, n, share):
    """n good documents; each measure is 0 but in that share of them."""
    return [[rng.random() if rng.random() < share else 0.0 for _ in q.MEASURES] for _ in range(n)]


def test_chosen_cutoffs_equal_brute_force(spark):
    """Strata of many and of few labels, a null one, and one that is a small part of all but has enough."""
    rng = random.Random(6)
    rows = []
    for stratum, n, share in (("en", 6000, 0.004), ("de", 2500, 0.002), (None, 1800, 0.0), ("fr", 900, 0.0), ("small", 1500, 0.0005), ("bad", 3000, 0.2), ("big", 400_000 // 40, 0.01)):
        rows += [(stratum, int(rng.random() < 0.95), x) for x in drawn(rng, n, share)]
    table = spark.createDataFrame([(s, y, *x) for s, y, x in rows], "stratum string, quality int, " + ", ".join(f"{m} double" for m in q.MEASURES))
    got = {x.stratum: [getattr(x, f"max_{m}") for m in q.MEASURES] for x in q.cutoffs(table).collect()}
    want = brute_cutoffs(rows)
    assert got == want and {"en", None, "small"} < set(want) and "fr" not in want


def test_joint_false_rejection_keeps_the_risk():
    """Over drawn holdouts, the rules that are chosen reject more than the risk of good documents in fewer than a twentieth."""
    rng = random.Random(7)
    broken = decided = 0
    for trial in range(60):
        share = (0.001, 0.004, 0.02)[trial % 3]
        found = brute_cutoffs([("s", 1, x) for x in drawn(rng, 2500, share)]).get("s")
        if found:
            decided += 1
            kept = math.prod(1 - share * (1 - c) for c in found if c is not None)
            broken += 1 - kept > 0.02
    assert decided >= 30 and broken <= 0.05 * 60
