"""The three modes: records to a saved graph, a saved graph to a table of precisions, and both."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import bloom
from simloom.functions.estimators import hash_count
from simloom.functions.text import bigrams
from simloom.operators import candidates, evaluate, graph, graphwave, matching, neural, prepare, scaling, simjoin
from simloom.operators.blocking import block_keys, choose_positions, word_bit
from simloom.plans.settings import DEFAULT_GRID, GraphWave, Settings, describe, embeddings, load_grid
from simloom.scratch import stored
from simloom.sources import records as source
from simloom.sources import results, store


def _blocks(nodes: DataFrame, settings: Settings, length: int, seed: int) -> DataFrame | None:
    if not settings.lsh_size_blocking:
        return None
    passes = choose_positions(settings.lsh_count_blocking, settings.lsh_size_blocking, length, seed)
    return block_keys(nodes.select("nid", *bloom.word_names(length)), passes, word_bit()).select("nid", "pass", "blk")


def estimated_hashes(plain: DataFrame, encoded: DataFrame, attributes: list[str], column: str, length: int, padding: bool = False) -> int:
    """The hash count from the mean bits of all distinct filters and the mean bigrams of all plain rows, repeated ones included."""
    filters = encoded.select(F.col(column).alias("key")).distinct().select(*bloom.decode(F.col("key"), length))
    bits = stored(filters).select(bloom.popcount(bloom.word_names(length)).alias("bits"))
    return hash_count(bits, "bits", plain.select(bigrams(*attributes, padding=padding).alias("grams")), "grams", length)


def build_graph(plain: DataFrame, encoded: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """nodes, edges, features and matches of both sides from record tables with row_idx.

    Node ids are twice the row for plain nodes and one more for encoded ones, so that both sides are
    one graph without common nodes.
    """
    attributes, spark = list(settings.qgram_attributes), plain.sparkSession
    length = bloom.filter_length(encoded, settings.encoded_attr)
    u = stored(prepare.plain_nodes(plain, attributes, settings.padding))
    hashes = estimated_hashes(plain, encoded, attributes, settings.encoded_attr, length, settings.padding)
    v = stored(prepare.encoded_nodes(encoded, settings.encoded_attr, length, hashes))
    u_blocks = v_blocks = None
    if settings.lsh_size_blocking:
        # blocks of plain nodes come from their own filters, as the encoded side's come from its
        own = bloom.words_of(bloom.positions(u, id_col="nid", hashes=hashes, length=length), "nid", length)
        u_blocks, v_blocks = _blocks(own, settings, length, settings.seed), _blocks(v, settings, length, settings.seed + 1)
    sides = []
    for side, nodes, edges in (
        (0, u, simjoin.plain_edges(u, settings.threshold, u_blocks)),
        (1, v, simjoin.encoded_edges(v, settings.threshold, length, hashes, v_blocks)),
    ):
        began = time.time()
        kept = stored(graph.create_graph(edges, settings.min_comp_size))
        sides.append((side, nodes, kept, nodes.count(), time.time() - began))
    most = max(x[3] for x in sides) - 1
    both = lambda i, s: F.col(i) * 2 + s
    nodes, edges, features = [], [], []
    for side, own, kept, _, _ in sides:
        began = time.time()
        table = stored(scaling.scale(graph.node_features(kept, own, settings.node_features, max(1, most), settings.node_count), settings.nf_scaled))
        results.append_timing(spark, settings.results_path, settings.record_count, settings.threshold, settings.node_features, time.time() - began)
        nodes.append(own.select(both("nid", side).alias("nid"), F.lit("uv"[side]).alias("side"), "key", F.col("qgrams_count").cast("double").alias("qgrams_count"), "node_count"))
        edges.append(kept.select(both("src", side).alias("src"), both("dst", side).alias("dst"), "weight"))
        features.append(table.select(both("nid", side).alias("nid"), F.lit("uv"[side]).alias("side"), "features"))
    truth = prepare.ground_truth(u, v)
    return {"nodes": nodes[0].unionByName(nodes[1]), "edges": edges[0].unionByName(edges[1]), "features": features[0].unionByName(features[1]), "matches": truth}


def graph_save(spark: SparkSession, settings: Settings) -> str:
    sides = []
    for path, share, seed in ((settings.plain_file, settings.remove_frac_plain, settings.seed), (settings.encoded_file, settings.remove_frac_encoded, settings.seed + 2)):
        rows = source.restrict(source.read_records(spark, path), settings.record_count)
        sides.append(source.sample_exact(rows, share, seed) if share else rows)
    meta = store.GraphMeta(
        settings.record_count, settings.threshold, settings.remove_frac_plain, settings.remove_frac_encoded, settings.min_comp_size,
        settings.node_features, settings.node_count, settings.nf_scaled, settings.lsh_count_blocking if settings.lsh_size_blocking else 0, settings.lsh_size_blocking,
    )
    return store.save_graph(settings.graph_path, build_graph(*sides, settings), meta)


def embed(edges: DataFrame, features: DataFrame, settings) -> DataFrame:
    """(nid, emb) for the embedding that the settings describe."""
    if isinstance(settings, GraphWave):
        return graphwave.graphwave(edges, list(settings.scales) if settings.scales else None, settings.sample_points, settings.order, settings.weighted)
    if settings.technique == "graphsage":
        return neural.learned(edges, features, "graphsage", layers=settings.layers, samples=settings.num_samples, walks=settings.number_of_walks, length=settings.length, batch=settings.batch_size, epochs=settings.epochs)
    return neural.learned(edges, features, "deepgraphinfomax", layers=settings.layers, activations=settings.activation, epochs=settings.epochs)


def matches_of(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """(rank, u_key, v_key) from distinct pairs (u, v, cos): scored, matched, and the best for the largest report."""
    scored = candidates.rescore(pairs, settings.vidanage_weights)
    found = matching.match(scored, settings.node_matching_tech, max(settings.num_top_pairs))
    key = lambda side, name: nodes.where(F.col("side") == side).select(F.col("nid").alias(side), F.col("key").alias(name))
    return found.join(key("u", "u_key"), "u").join(key("v", "v_key"), "v").select("rank", "u_key", "v_key")


def _scales(setting, nodes: int) -> list[float] | None:
    """The scales that a GraphWave setting comes to, chosen ones included; None for other embeddings."""
    if not isinstance(setting, GraphWave):
        return None
    return list(setting.scales or (graphwave.auto_scales(max(1, nodes)) if setting.weighted else graphwave.DEFAULT_SCALES))


def graph_load(spark: SparkSession, path: str, settings: Settings, grids: dict | None = None) -> DataFrame:
    """(technique, description, weight, k, tp, precision): features alone, each embedding alone, and each mixture.

    weight is the embedding's share: 1 alone, and 1 less the features' share in a mixture. Cosines of
    both channels are computed once for each embedding and kept where either reaches the threshold; the
    mixtures only weigh them anew.
    """
    tables, meta = store.load_graph(spark, path)
    edges = tables["edges"]
    if settings.mode == "graph_load" and settings.min_comp_size:
        edges = stored(graph.filter_components(edges, settings.min_comp_size))
    ends = stored(edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct())
    features = stored(tables["features"].join(ends, "nid", "left_semi"))
    nodes, truth, n = tables["nodes"], tables["matches"], ends.count()
    folder = path.replace("\\", "/").rstrip("/").split("/")
    runs: list[DataFrame] = []

    def report(pairs: DataFrame, technique: str, description: str, weight: float | None, more: dict) -> None:
        found = stored(matches_of(pairs, nodes, settings))
        out = stored(evaluate.precision_at(found, truth, settings.num_top_pairs))
        values = {
            "file": path, "dataset": folder[-2] if len(folder) > 1 else "", "record_count": meta.record_count, "threshold": meta.threshold, "removed_records_plain": meta.removed_plain,
            "removed_records_encoded": meta.removed_encoded, "node_features": meta.node_features, "ks": settings.num_top_pairs, "no_matches": found.count(),
            "graph_matching_tech": settings.node_matching_tech, "lsh_count_nm": settings.lsh_count_node_matching, "lsh_size_nm": settings.lsh_size_node_matching,
            "cos_sim_threshold": settings.node_matching_threshold, "hyperplane_count": settings.hyperplanes, "min_comp_size": max(meta.min_comp_size, settings.min_comp_size), "scaler": settings.scaler,
            "vidanage_weights": settings.vidanage_weights, "lsh_count_blk": meta.lsh_count, "lsh_size_blk": meta.lsh_size, **more, "weight": weight,
        }
        results.append(results.result_row(out, values, technique), settings.results_path, f"{technique}_results")
        runs.append(out.select(F.lit(technique).alias("technique"), F.lit(description).alias("description"), F.lit(weight).cast("double").alias("weight"), "k", "tp", "precision"))

    def pairs_of(table: DataFrame, columns: list[str], any_channel: bool) -> DataFrame:
        u, v = (table.where(F.col("side") == s) for s in "uv")
        if settings.lsh_size_node_matching:
            u, v = (candidates.buckets(x, columns, settings.lsh_count_node_matching, settings.lsh_size_node_matching, settings.seed, settings.hyperplanes) for x in (u, v))
        return candidates.cosine_pairs(u, v, settings.node_matching_threshold, columns, any_channel=any_channel)

    scaled = stored(scaling.scale(features, settings.scaler))
    report(pairs_of(scaled, ["features"], False), "features", "features alone", None, {})
    grids = grids or (load_grid(settings.hp_config_file) if settings.hp_config_file else DEFAULT_GRID)
    for setting in embeddings(grids):
        if settings.graphwave_unweighted and isinstance(setting, GraphWave):
            setting = GraphWave(setting.sample_points, setting.scales, setting.order, weighted=False)
        # as the features, every embedding is scaled before cosines are taken
        own = scaling.scale(stored(embed(edges, features, setting)), settings.scaler, "emb")
        table = scaled.join(own, "nid")
        pairs = stored(pairs_of(table, ["features", "emb"], True))
        more = {**vars(setting), "type": "unweighted" if settings.graphwave_unweighted else "weighted", "scales": _scales(setting, n), "sample_points_linspace": getattr(setting, "sample_points", None), "order_approx": getattr(setting, "order", None)}
        for share in (0.0, *settings.weight_list):
            cos = share * F.col("cos_0") + (1 - share) * F.col("cos_1")
            mixed = pairs.select("u", "v", cos.alias("cos")).where(F.col("cos") >= settings.node_matching_threshold)
            report(mixed, setting.technique, describe(setting), round(1 - share, 12), more)
    out = runs[0]
    for x in runs[1:]:
        out = out.unionByName(x)
    return out


def run(spark: SparkSession, settings: Settings) -> DataFrame | None:
    if settings.mode == "graph_load":
        return graph_load(spark, settings.saved_graph, settings)
    path = graph_save(spark, settings)
    return graph_load(spark, path, settings) if settings.mode == "graph_save_calculate" else None
