"""A saved graph comes back whole: both sides' edges, and the other tables, which graph_store doesn't return."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from simloom import queries as q
from simloom.plans import pipeline
from simloom.sources import store


def rows_of(table, columns):
    return Counter(repr(x) for x in table.select(*columns).collect())


@pytest.fixture(scope="module")
def saved(spark, sf, tmp_path_factory):
    """What save_graph was given, and where it went."""
    held, real = [], store.save_graph
    patch = pytest.MonkeyPatch()

    def save(folder, tables, meta):
        held.append({k: v.cache() for k, v in tables.items()})
        return real(folder, held[0], meta)

    patch.setattr(store, "save_graph", save)
    path, _ = q._saved(spark, sf, f"file://{tmp_path_factory.mktemp('graphs')}")
    patch.undo()
    return held[0], path


def test_all_tables_of_both_sides_come_back(spark, saved):
    given, path = saved
    got, _ = store.load_graph(spark, path)
    assert set(got) == set(store.TABLES)
    for name in store.TABLES:
        assert set(got[name].columns) == set(given[name].columns)
        want = rows_of(given[name], given[name].columns)
        assert want and rows_of(got[name], given[name].columns) == want, name
    assert {x[0] for x in got["edges"].select(F.pmod("src", F.lit(2))).distinct().collect()} == {0, 1}
