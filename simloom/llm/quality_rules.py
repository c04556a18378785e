"""Quality rules with risk-controlled thresholds, with DataFrame and SQL functions only.

A rule rejects a document if one of its measures is above a cutoff. The cutoffs are not set by hand:
for each stratum (language) the labelled holdout says how many good documents a cutoff would reject.
A document goes if any rule rejects it, so the risk is that of all rules together. A set of cutoffs,
one or none for each measure, is valid if the exact binomial test rules out, at a level divided by the
number of all such sets of all strata (Bonferroni), that together they reject more than `risk` of good
documents. Each measure uses the strictest cutoff that rejects at most its equal part of the largest
count with which a set is valid; together they reject no more than that count. With probability
`1 - level`, the rules of no stratum reject more than `risk` of its good documents.

Each stratum learns from its own labels, however few or many these are among all. One whose good
labels don't suffice for any cutoff (about 1,100 do) is judged by the base rules alone: no bound would
hold for cutoffs taken from elsewhere. A null stratum is one as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm._common import BLANK, scope, stored, whole_text

#: The measures that cutoffs are learned for, each the larger the worse, and the steps they are tried at.
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "short_words", "long_words")
GRID = tuple(round(x / 100, 2) for x in (*range(0, 20, 1), *range(20, 101, 5)))
SYMBOLS = "#*$%&|<>"
#: Strata with cutoffs that are broadcast, a few numbers each; more of them are joined by a shuffle.
MOST_BROADCAST = 10_000


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measured(docs: DataFrame, *, text_col: str = "text", size: int = 5) -> DataFrame:
    """docs as `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null or empty text counts 0 everywhere. Each row is measured by itself, whole, without a shuffle.
    Windows are compared by a 64-bit hash within their own document. Where all are distinct, one hash
    set says so; else the sorted (hash, position) pairs show which repeat.
    """
    text = whole_text(text_col)
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.split(F.btrim(text, F.lit(BLANK)), r"[\x20\x09-\x0D]+", -1).alias("words"))
    rows = rows.withColumn("n_words", F.when(F.col("words")[0] == "", F.lit(0)).otherwise(F.size("words")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    n = F.col("n_words")
    window = lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(size)))
    rows = rows.withColumn("windows", F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), window)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("again"), placed))
    twin = lambda p, k: (F.get(F.col("placed"), k - 1)["h"] == p["h"]) | (F.get(F.col("placed"), k + 1)["h"] == p["h"])
    rows = rows.withColumn("twins", F.array_sort(F.transform(F.filter("placed", lambda p, k: F.coalesce(twin(p, k), F.lit(False))), lambda p: p["i"])))
    # each repeated window covers what lies before the next one, at most its own size
    cover = F.aggregate(
        "twins", F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(size))).alias("n")),
    )["n"]
    return rows.select(
        "row",
        n.cast("long").alias("n_words"),
        F.when(n == 0, F.lit(0)).otherwise(F.length(_without(F.col("text"), BLANK))).cast("long").alias("word_chars"),
        F.when(n == 0, F.lit(0)).otherwise(F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def shares() -> list[Column]:
    """The measures as shares between 0 and 1; 0 where there is nothing to measure."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    mean = part("word_chars", "n_words")
    return [
        part("n_symbols", "word_chars").alias("symbol_share"),
        part("n_dup_lines", "n_lines").alias("dup_line_share"),
        part("n_repeat_words", "n_words").alias("repeat_share"),
        # 0 for words of four code points and more on average, 1 for single ones
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (4 - mean) / 3)).alias("short_words"),
        # 0 for up to eight on average, 1 for eighteen and more
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - 8) / 10)).alias("long_words"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed from its terms' logarithms, exact up to rounding.

    Terms are scaled by the largest, which is the last as long as k <= n * p; beyond that the tail is
    over a half or nearly so, and 1 is returned.
    """
    odds = math.log(p) - math.log1p(-p)
    # ratio of term i - 1 to term i: i / (n - i + 1) * (1 - p) / p; summed downwards from term k
    # state: (term relative to the last, sum of these, log of the last term)
    walk = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), (n * F.lit(math.log1p(-p))).alias("log")),
        lambda a, i: F.struct(
            (a["term"] * i / (n - i + 1) * F.lit(math.exp(-odds))).alias("term"),
            (a["sum"] + a["term"] * i / (n - i + 1) * F.lit(math.exp(-odds))).alias("sum"),
            (a["log"] + F.log((n - i + 1) / i) + F.lit(odds)).alias("log"),
        ),
    )
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(walk["log"]) * walk["sum"])


def cutoffs(holdout: DataFrame, *, risk: float = 0.02, level: float = 0.05, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, and the cutoff of each measure, null where none is valid) from labelled documents.

    holdout has stratum, quality and the measures. Only good documents that the base rules pass count.
    Strata without a valid cutoff have no row.
    """
    good = holdout.where(F.col("quality") == 1)
    above = [F.count(F.when(F.col(m) > c, 1)).alias(f"{m}/{i}") for m in MEASURES for i, c in enumerate(grid)]
    counts = stored(good.groupBy("stratum").agg(F.count("*").alias("n"), *above))
    tests = counts.count() * (len(grid) + 1.0) ** len(MEASURES)  # a measure may have no cutoff
    tried = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(float(c)).alias("cutoff"), F.col(f"`{m}/{i}`").alias("k")) for m in MEASURES for i, c in enumerate(grid)))
    long = counts.select("stratum", "n", F.explode(tried).alias("t"))
    valid = long.where(binomial_tail(F.col("t.k") * len(MEASURES), F.col("n"), risk) <= F.lit(level / max(1.0, tests)))
    return valid.groupBy("stratum").agg(*(F.min(F.when(F.col("t.measure") == m, F.col("t.cutoff"))).alias(f"max_{m}") for m in MEASURES))


def judged(docs: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """(doc_id, stratum, the counts, n_lines, base_failed, the measures, kept) with a row for each row of docs.

    labels has doc_id and quality (1 or 0; of several for a document the smallest counts, a null says
    nothing). Without labels there are no cutoffs, and the base rules alone decide; so they do for
    strata that the labels don't hold. A null or empty text fails the base rules, repeated rows are
    judged alike, an empty table gives no rows, and other columns play no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    with scope(docs.sparkSession) as keep:
        # narrow counts of all documents are stored once: they serve both the holdout and the verdicts
        wide = measured(docs.select("doc_id", F.col(stratum_col).alias("stratum"), "text")).select("row.doc_id", "row.stratum", *COUNTS, "n_lines", base_failed().alias("base_failed"))
        table = keep(stored(wide.select("*", *shares())))
        holdout = table.where(~F.col("base_failed")).join(known, F.col("doc_id").cast("long") == F.col("id")).select("stratum", "quality", *MEASURES)
        found = keep(stored(cutoffs(holdout, risk=risk, level=level).withColumnRenamed("stratum", "home")))
    rules = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    out = table.join(rules, F.col("stratum").eqNullSafe(F.col("home")), "left")
    rejected = F.lit(False)
    for m in MEASURES:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("home", *(f"max_{m}" for m in MEASURES))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept")
