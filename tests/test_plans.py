import base64
import dataclasses
import math
import random
from pathlib import Path

import numpy as np
import pytest

from simloom import scratch
from simloom.operators import prepare
from simloom.operators.graphwave import auto_scales
from simloom.plans import cli, pipeline
from simloom.plans.settings import DEFAULT_GRID, Settings, embeddings, fraction, grid, load_grid, to_shares
from simloom.scratch import stored
from simloom.sources import records, results, store


def test_command_line():
    s = cli.parse(["graph_save_calculate", "a.csv", "b.csv", "0.4", "--remove_frac_plain", "0.1", "--node_matching_tech", "mwm", "--scaler", "minmaxscaler", "--vidanage_weights", "6", "3", "1", "--weight_list", "0.5"])
    assert (s.mode, s.threshold, s.remove_frac_plain, s.node_matching_tech, s.scaler, s.weight_list) == ("graph_save_calculate", 0.4, 0.1, "mwm", "minmax", (0.5,))
    assert abs(sum(s.vidanage_weights) - 1) < 1e-12
    assert cli.parse(["graph_load", "x"]).min_comp_size == 0
    with pytest.raises(SystemExit):
        cli.parse(["graph_load", "x", "--node_matching_tech", "other"])


def test_grids_go_in_step():
    assert len(list(embeddings(DEFAULT_GRID))) == 3
    assert [x.epochs for x in grid("graphsage", {"layers": [[8, 4], [4, 2]], "epochs": [1, 2]})] == [1, 2]
    with pytest.raises(ValueError):
        list(grid("graphsage", {"layers": [[8, 4]], "epochs": [1, 2]}))
    with pytest.raises(ValueError):
        fraction("1.5")
    assert to_shares((2, 1, 1)) == (0.5, 0.25, 0.25)


def test_names_are_read_back():
    meta = store.GraphMeta(1000, 0.4, 0.1, 0.2, 3, "egonet1", True, "standard", 2, 8)
    assert store.dataset_name(meta) == "c1000_t0.4_comp3_r0.1e0.2_lshc2_lshs8_egonet1_nodeCount_std"
    assert store.parse_name(store.dataset_name(meta)) == meta
    old = store.parse_name("c100_t0.5_r0.2_histo")
    assert old.removed_encoded == 0.2 and old.node_features == "all"
    assert dataclasses.asdict(store.GraphMeta())["threshold"] == 0.4


def test_records(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("first_name,last_name,n\n" + "".join(f"a{i},,{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = records.read_records(spark, str(path))
        got = {x.row_idx: x for x in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 500 and all(got[i].first_name == f"a{i}" and got[i].last_name == "" for i in got)
    table = spark.range(1000).withColumnRenamed("id", "row_idx")
    assert [records.restrict(table, n).count() for n in (7, -7, 0)] == [7, 7, 1000]
    assert min(x.row_idx for x in records.restrict(table, -7).collect()) == 993
    one = {x.row_idx for x in records.sample_exact(table, 0.25, 3).collect()}
    assert len(one) == 750 and one == {x.row_idx for x in records.sample_exact(table.repartition(7), 0.25, 3).collect()}
    assert records.sample_exact(table, 1.0, 3).count() == 0 and records.sample_exact(table, 0.0, 3).count() == 1000


def test_records_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('first_name,last_name\n"a\nb",x\nc,"say ""hi"", twice"\n,\n"d\n\n",y\n')
    rows = sorted(records.read_records(spark, str(path)).collect(), key=lambda x: x.row_idx)
    assert [tuple(x) for x in rows] == [("a\nb", "x", 0), ("c", 'say "hi", twice', 1), ("", "", 2), ("d\n\n", "y", 3)]


def test_files_with_one_dict_for_each_technique(tmp_path):
    path = tmp_path / "grid.py"
    path.write_text(
        "L, E, A, S, C = 'LAYER_STRUCTURES_LIST', 'EPOCHS_LIST', 'ACTIVATION_FUNC_LIST', 'SAMPLE_PCT_LIST', 'SCALES_LIST'\n"
        "graphsage_settings = {L: [[8, 4], [6, 2]], 'NUM_SAMPLES_LIST': [[3, 2], [2, 2]], E: [1, 2]}\n"
        "deepgraphinfomax_settings = {L: [[8, 4]], A: [['relu', 'tanh']], E: [3]}\n"
        "graphwave_settings = {S: [(0, 50, 5), (0, 10, 3)], C: [['auto'], [1.0, 2.0]]}\n"
    )
    wave, wave2, dgi, sage, sage2 = embeddings(load_grid(str(path)))
    assert (wave.scales, wave2.scales, wave2.sample_points) == (None, (1.0, 2.0), (0, 10, 3))
    assert (dgi.layers, dgi.activation, dgi.epochs) == ((8, 4), ("relu", "tanh"), 3)
    assert (sage.layers, sage.num_samples, sage2.epochs) == ((8, 4), (3, 2), 2)
    path.write_text("X = 1")
    with pytest.raises(ValueError):
        load_grid(str(path))


def people(tmp_path):
    """Two files of the same people: names, and Bloom filters of their names."""
    rng = random.Random(8)
    part = lambda: "".join(rng.choice(["an", "be", "ro", "mi", "ka", "lu"]) for _ in range(3))
    names = []
    for _ in range(14):
        a, b = part(), part()
        names += [(a, b), (a + "s", b), (a, b + "n"), ("x" + a, b)]
    names += names[:5]  # rows that repeat
    (tmp_path / "plain.csv").write_text("first_name,last_name\n" + "".join(f"{a},{b}\n" for a, b in names))
    return names


def test_a_whole_run_writes_every_sink(spark, tmp_path):
    names = people(tmp_path)
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "row_idx long, first_name string, last_name string")
    filters = prepare.encode_records(rows, ["first_name", "last_name"], 7, 256).orderBy("row_idx").collect()
    (tmp_path / "encoded.csv").write_text("base64_bf\n" + "".join(f"{x.base64_bf}\n" for x in filters))
    (tmp_path / "grid.py").write_text(
        "GRID = {'graphwave': {'sample_points': [(0, 20, 4)], 'scales': [None]}, 'deepgraphinfomax': {'layers': [[6, 4]], 'activation': [['relu', 'tanh']], 'epochs': [2]},"
        " 'graphsage': {'layers': [[6, 4]], 'num_samples': [[3, 2]], 'epochs': [1]}}"
    )
    base = Settings(
        "graph_save_calculate", f"{tmp_path}/plain.csv", f"{tmp_path}/encoded.csv", f"file://{tmp_path}/graphs", threshold=0.5, node_features="egonet1", results_path=f"file://{tmp_path}/results",
        weight_list=(0.25,), hp_config_file=f"{tmp_path}/grid.py", num_top_pairs=(3, 5), node_matching_threshold=0.2, scaler="standard",
    )
    scaled, matched = [], []
    patch = pytest.MonkeyPatch()
    scale, matches_of = pipeline.scaling.scale, pipeline.matches_of
    patch.setattr(pipeline.scaling, "scale", lambda rows, kind, column="features": scaled.append((kind, column)) or scale(rows, kind, column))
    patch.setattr(pipeline, "matches_of", lambda *a: matched.append(stored(matches_of(*a))) or matched[-1])
    try:
        out = pipeline.run(spark, base)
    finally:
        patch.undo()
    # the bits of distinct filters, the bigrams of all rows
    sets = [{w[i : i + 2] for w in n for i in range(len(w) - 1)} for n in names]
    ones = [sum(bin(byte).count("1") for byte in base64.b64decode(x)) for x in {x.base64_bf for x in filters}]
    hashes = round(math.log(1 - np.mean(ones) / 256) / math.log(1 - 1 / 256) / np.mean([len(x) for x in sets]))
    plain, encoded = (records.read_records(spark, x) for x in (base.plain_file, base.encoded_file))
    assert pipeline.estimated_hashes(plain, encoded, ["first_name", "last_name"], "base64_bf", 256) == hashes
    # features alone, then each embedding alone and in one mixture; all embeddings are scaled
    assert scaled.count(("standard", "emb")) == 3 and ("standard", "features") in scaled
    counts = [x.count() for x in matched]
    assert len(counts) == 7 and max(counts) == 5  # the best for the largest report
    name = "c0_t0.5_comp3_r0.0e0.0_egonet1"
    common = {"file": f"file://{tmp_path}/graphs/{name}", "dataset": "graphs", "record_count": "0", "threshold": "0.5", "removed_records_plain": "0.0", "removed_records_encoded": "0.0", "node_features": "egonet1"}
    common |= {"graph_matching_tech": "shm", "lsh_count_nm": "1", "lsh_size_nm": "0", "cos_sim_threshold": "0.2", "hyperplane_count": "1024", "min_comp_size": "3", "scaler": "standard", "vidanage_weights": "(0.6, 0.3, 0.1)", "lsh_count_blk": "0", "lsh_size_blk": "0"}
    nodes = spark.read.parquet(f"file://{tmp_path}/graphs/{name}/edges").selectExpr("explode(array(src, dst)) AS n").distinct().count()
    own = {
        "features": [{}],
        "graphwave": [{"type": "weighted", "scales": str(auto_scales(nodes)), "sample_points_linspace": "(0, 20, 4)", "order_approx": "30"}] * 2,
        "deepgraphinfomax": [{"layers": "(6, 4)", "activation": "('relu', 'tanh')", "epochs": "2"}] * 2,
        "graphsage": [{"layers": "(6, 4)", "num_samples": "(3, 2)", "number_of_walks": "1", "length": "5", "batch_size": "512", "epochs": "1"}] * 2,
    }
    got, at = out.collect(), 0
    for technique, want in own.items():
        sink = [x.asDict() for x in results.read_results(spark, base.results_path, f"{technique}_results").collect()]
        assert len(sink) == len(want)
        sink.sort(key=lambda x: -float(x.get("weight", 1)))
        for row, more, weight in zip(sink, want, ("1.0", "0.75")):
            assert row.pop("no_matches") == str(counts[at]), technique
            assert technique == "features" or row.pop("weight") == weight
            for k in (3, 5):
                tp = [x for x in got if x.technique == technique and x.k == k and x.weight in (None, float(weight))]
                assert len(tp) == 1 and row.pop(f"precision_{k}") == tp[0].precision == tp[0].tp / k
            assert row == common | more
            at += 1
    assert results.read_results(spark, base.results_path, "performance/nf").count() == 2
    # a larger component size given at load is the one that holds, and is recorded
    again = dataclasses.replace(base, mode="graph_load", saved_graph=common["file"], min_comp_size=4, results_path=f"file://{tmp_path}/more", hp_config_file="", weight_list=())
    pipeline.graph_load(spark, again.saved_graph, again, {"graphwave": {"sample_points": [(0, 20, 4)], "scales": [[2.0]]}})
    assert results.read_results(spark, again.results_path, "features_results").first().min_comp_size == "4"
    assert results.read_results(spark, again.results_path, "graphwave_results").first().scales == "[2.0]"


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        held = {"spark.master": "spark://host:7077"}

        def get(self, name, default=None):
            return self.held.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())
    Conf.held["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert scratch.shared_folder(Session()) == "hdfs://x/y"


def test_scopes_delete_what_they_made(spark, tmp_path):
    alive = lambda t: Path(t._simloom_path.removeprefix("file:")).exists()
    rows = spark.range(5)
    with scratch.scope(spark) as outer:
        with scratch.scope(spark) as keep:
            a, b = stored(rows), keep(stored(rows))
        assert not alive(a) and alive(b) and b.count() == 5
        c = outer(stored(rows))
        d = stored(rows)
        scratch.drop(d, rows)
        assert not alive(d)
    assert not alive(b) and alive(c)
    with pytest.raises(ZeroDivisionError):
        with scratch.scope(spark) as keep:
            e = keep(stored(rows))
            1 / 0
    assert not alive(e)
