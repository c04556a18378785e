"""Character bigrams of record attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grams(text: Column) -> Column:
    # sequence() would count down for texts of fewer than two characters
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2))
    return F.when(F.length(text) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(*attributes: Column | str, padding: bool = False) -> Column:
    """The sorted set of bigrams of all attributes; none spans two of them.

    With padding, each attribute gets `_` at both ends, so an empty one yields `__`. Null is empty.
    """
    texts = [F.coalesce((F.col(a) if isinstance(a, str) else a).cast("string"), F.lit("")) for a in attributes]
    texts = [F.concat(F.lit("_"), t, F.lit("_")) for t in texts] if padding else texts
    return F.array_sort(F.array_distinct(F.flatten(F.array(*map(_grams, texts)))))


def gram_key(grams: Column) -> Column:
    """One text for a sorted set of bigrams: the identity of a plain node."""
    return F.array_join(grams, "|")
