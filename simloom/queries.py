"""One query for each operator, over the driver's tables. oracles.py says the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import bloom, text
from simloom.functions.murmur import murmur3
from simloom.operators import blocking, candidates, evaluate, graph, graphwave, matching, neural, prepare, scaling, scoredpairs, simjoin
from simloom.plans import pipeline
from simloom.plans.settings import Settings
from simloom.scratch import shared_folder, stored
from simloom.sources import records as source
from simloom.sources import results, store

LENGTH, HASHES, THRESHOLD, COSINE = 1024, 10, 0.6, 0.3
#: Fixed draws, shared with the SQL.
PASSES = blocking.choose_positions(3, 6, LENGTH, seed=21)
PLANE_SEED, PLANE_PASSES = 22, blocking.choose_positions(2, 3, 1024, seed=22)
KS = (1, 5, 10, 50, 100)


def r(c: Column | str, name: str | None = None) -> Column:
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_idx"), "p_name", "p_type", "p_brand")


def plain(spark: SparkSession, sf: str, *attributes: str, padding: bool = False) -> DataFrame:
    return prepare.plain_nodes(part(spark, sf), list(attributes or ("p_name",)), padding)


def edges(spark: SparkSession, sf: str, *attributes: str) -> DataFrame:
    return simjoin.plain_edges(plain(spark, sf, *attributes), THRESHOLD)


def grams(spark: SparkSession, sf: str, padding: bool = False) -> DataFrame:
    return part(spark, sf).select("row_idx", text.bigrams("p_name", padding=padding).alias("grams"))


def encoded_records(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.encode_records(part(spark, sf), ["p_name"], HASHES, LENGTH)


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.encoded_nodes(encoded_records(spark, sf), "base64_bf", LENGTH, HASHES)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("nid"), F.col("embedding").alias("emb"), "label")
    return rows.where("nid % 2 = 0"), rows.where("nid % 2 = 1")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.cosine_pairs(*sides(spark, sf), COSINE).select("u", "v", "cos")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.rescore(stored(pairs(spark, sf)))


# ---------------------------------------------------------------- records


def head_slice(spark, sf):
    return source.restrict(part(spark, sf).withColumn("row_idx", F.col("row_idx") - 1), 50).select("row_idx", "p_name")


def tail_slice(spark, sf):
    return source.restrict(part(spark, sf).withColumn("row_idx", F.col("row_idx") - 1), -50).select("row_idx", "p_name")


def sample_exact(spark, sf):
    return source.sample_exact(part(spark, sf), 0.2, seed=3).select("row_idx", "p_name")


def dedup_node_count(spark, sf):
    return plain(spark, sf).select("nid", "key", "qgrams_count", "node_count")


def ground_truth(spark, sf):
    return prepare.ground_truth(plain(spark, sf), encoded(spark, sf)).select("nid", "u_key", "v_key")


def ground_truth_all_rows(spark, sf):
    keys = grams(spark, sf).select(F.col("row_idx").alias("nid"), text.gram_key(F.col("grams")).alias("key"))
    filters = encoded_records(spark, sf).select(F.col("row_idx").alias("nid"), F.col("base64_bf").alias("key"))
    return prepare.ground_truth(keys, filters, "all_rows").select("nid", "u_key", "v_key")


def csv_scan(spark, sf):
    """Records with quotes and line breaks in quoted fields, written as CSV and read back."""
    path = f"{_folder(spark)}/records"
    rows = part(spark, sf).select("row_idx", F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", ')).alias("name"), F.when(F.col("row_idx") % 3 != 0, F.col("p_type")).alias("kind"))
    rows.repartitionByRange(1, "row_idx").sortWithinPartitions("row_idx").drop("row_idx").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return source.read_records(spark, path)


def dataset_names(spark, sf):
    """Names of graphs' parameters, and what is read back from them, for a setting by region."""
    keys = [x.r_regionkey for x in table(spark, sf, "region").select("r_regionkey").collect()]  # five rows
    metas = [store.GraphMeta(k * 100 - 100, 0.4, k / 10, 0.25, k, ("fast", "egonet1", "egonet2", "all")[k % 4], k % 2 == 0, ("", "minmax", "standard")[k % 3], k % 2, 8 * (k % 2)) for k in keys]
    rows = [(k, store.dataset_name(m), *(str(x) for x in vars(store.parse_name(store.dataset_name(m))).values())) for k, m in zip(keys, metas)]
    fields = "record_count threshold removed_plain removed_encoded min_comp_size node_features node_count scaler lsh_count lsh_size".split()
    return spark.createDataFrame(rows, "region long, name string, " + ", ".join(f"{x} string" for x in fields))


def side_ids(spark, sf):
    rows = prepare.side_ids(plain(spark, sf), "u")
    return rows.select("nid", "side", "id", prepare.strip_prefix("id").alias("stripped"))


# ---------------------------------------------------------------- functions


def bigrams(spark, sf):
    return grams(spark, sf).select("row_idx", F.explode("grams").alias("gram"))


def bigrams_padded(spark, sf):
    return grams(spark, sf, padding=True).select("row_idx", F.explode("grams").alias("gram"))


def murmur_positions(spark, sf):
    rows = grams(spark, sf).select(F.explode("grams").alias("gram")).distinct().select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HASHES - 1).cast("long"))).alias("seed"))
    return rows.withColumn("hash", murmur3(F.col("gram"), F.col("seed"))).withColumn("pos", F.pmod("hash", F.lit(LENGTH)))


def bloom_positions(spark, sf):
    return bloom.positions(grams(spark, sf), hashes=HASHES, length=LENGTH).select("row_idx", F.col("pos").cast("long").alias("pos"))


def bloom_popcount(spark, sf):
    words = bloom.words_of(bloom.positions(grams(spark, sf), hashes=HASHES, length=LENGTH), length=LENGTH)
    return words.select("row_idx", bloom.popcount(bloom.word_names(LENGTH)).cast("long").alias("bits"))


def bloom_decode(spark, sf):
    rows = encoded_records(spark, sf)
    rows = stored(rows.select("row_idx", *bloom.decode(F.col("base64_bf"), LENGTH)))
    return bloom.set_positions(rows, length=LENGTH).select("row_idx", F.col("pos").cast("long").alias("pos"))


def hash_count_estimate(spark, sf):
    n = pipeline.estimated_hashes(part(spark, sf), encoded_records(spark, sf), ["p_name"], "base64_bf", LENGTH)
    return spark.range(1).select(F.lit(n).cast("long").alias("hashes"))


def qgram_estimates(spark, sf):
    return encoded(spark, sf).select("nid", F.col("bits").cast("long").alias("bits"), r("qgrams_count"), "node_count")


# ---------------------------------------------------------------- joins and blocks


def sim_edges_plain(spark, sf):
    return edges(spark, sf).select("src", "dst", r("weight"))


def sim_edges_wide(spark, sf):
    return edges(spark, sf, "p_name", "p_type").select("src", "dst", r("weight"))


def sim_edges_all_pairs(spark, sf):
    return simjoin.plain_edges(plain(spark, sf), 0.0).select("src", "dst", r("weight"))


def sim_edges_encoded(spark, sf):
    return simjoin.encoded_edges(encoded(spark, sf), THRESHOLD, LENGTH, HASHES).select("src", "dst", r("weight"))


def _block_keys(spark, sf):
    return blocking.block_keys(encoded(spark, sf).select("nid", *bloom.word_names(LENGTH)), PASSES, blocking.word_bit()).select("nid", "pass", "blk")


def lsh_block_keys(spark, sf):
    return _block_keys(spark, sf).select("nid", F.col("pass").cast("long").alias("pass"), "blk")


def block_stats(spark, sf):
    return blocking.block_stats(_block_keys(spark, sf)).select("blocks", "least", "most", r("mean"), r(F.col("median").cast("double"), "median"))


def sim_edges_blocked(spark, sf):
    return simjoin.encoded_edges(encoded(spark, sf), THRESHOLD, LENGTH, HASHES, _block_keys(spark, sf)).select("src", "dst", r("weight"))


# ---------------------------------------------------------------- graphs


def components(spark, sf):
    return graph.components(edges(spark, sf)).select("nid", "comp")


def filter_small_components(spark, sf):
    return graph.create_graph(edges(spark, sf), 4).select("src", "dst", r("weight"))


def edge_weight_stats(spark, sf):
    return graph.weight_stats(edges(spark, sf, "p_name", "p_type")).select("nid", "deg", r("wmax"), r("wmin"), r("wavg"), r("wstd"))


def degree_centrality(spark, sf):
    return graph.degree_centrality(stored(edges(spark, sf))).select("nid", r("degcentr"))


def egonet(spark, sf):
    return graph.egonets(stored(edges(spark, sf, "p_name", "p_type"))).select("nid", "ego_edges", r("ego_dens"))


def _long(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("nid", F.posexplode(column).alias("d", "x")).select("nid", F.col("d").cast("long").alias("d"), r("x"))


def _largest(own: DataFrame, least: int) -> int:
    """The largest degree, or `least` where none is larger: the SQL has bins for that, and no count is lost beyond it."""
    return max(least, graph.degrees(own).agg(F.max("deg")).first()[0] or 0)


def histo_1hop(spark, sf):
    own = stored(edges(spark, sf, "p_name", "p_type"))
    return _long(graph.one_hop_histogram(own, graph.bin_count(_largest(own, 255))), "h1")


def histo_2hop(spark, sf):
    own = stored(edges(spark, sf, "p_name", "p_type"))
    return _long(graph.two_hop_histogram(own, graph.bin_count(_largest(own, 255))), "h2")


def betweenness(spark, sf):
    return graph.betweenness(stored(edges(spark, sf))).select("nid", r("betw"))


def features_all(spark, sf):
    nodes = plain(spark, sf)
    own = stored(graph.create_graph(edges(spark, sf)))
    return _long(graph.node_features(own, nodes, "all", _largest(own, 7)), "features")


def _vectors(spark, sf) -> DataFrame:
    return graph.weight_stats(edges(spark, sf)).select("nid", F.array(*(F.col(c).cast("double") for c in ("deg", "wmax", "wmin", "wavg"))).alias("features"))


def scale_standard(spark, sf):
    return _long(scaling.scale(_vectors(spark, sf), "standard"), "features")


def scale_minmax(spark, sf):
    return _long(scaling.scale(_vectors(spark, sf), "minmax"), "features")


# ---------------------------------------------------------------- embeddings


def heat_kernel(spark, sf):
    return graphwave.heat_kernel(stored(edges(spark, sf)), 1.0).select("src", "dst", r("value"))


def graphwave_embedding(spark, sf):
    return _long(graphwave.graphwave(stored(edges(spark, sf))), "emb")


def graphwave_unweighted(spark, sf):
    return _long(graphwave.graphwave(stored(edges(spark, sf)), samples=(0, 50, 10), order=20, weighted=False), "emb")


def sage_mean_propagate(spark, sf):
    own = stored(edges(spark, sf))
    return _long(neural.sage_mean(own, _vectors(spark, sf)), "mean")


def gcn_propagate(spark, sf):
    own = stored(edges(spark, sf))
    return _long(neural.gcn(own, _vectors(spark, sf)), "out")


def graphsage_embedding(spark, sf):
    return _long(neural.learned(stored(edges(spark, sf)), scaling.scale(_vectors(spark, sf), "standard"), "graphsage", layers=(32, 16)), "emb")


def dgi_embedding(spark, sf):
    return _long(neural.learned(stored(edges(spark, sf)), scaling.scale(_vectors(spark, sf), "standard"), "deepgraphinfomax", layers=(16,)), "emb")


# ---------------------------------------------------------------- matching


def hyperplane_buckets(spark, sf):
    u, _ = sides(spark, sf)
    rows = candidates.buckets(u.select("nid", "emb"), ["emb"], 2, 3, PLANE_SEED)
    return rows.select("nid", F.col("pass").cast("long").alias("pass"), "blk")


def cosine_candidates(spark, sf):
    return pairs(spark, sf).select("u", "v", r("cos"))


def cosine_candidates_lsh(spark, sf):
    out = candidates.candidate_pairs(*(s.select("nid", "emb") for s in sides(spark, sf)), COSINE, ["emb"], None, 2, 3, seed=PLANE_SEED)
    return out.select("u", "v", r("cos"))


def weighted_cosine(spark, sf):
    return candidates.cosine_pairs(*_halves(spark, sf), COSINE, ["emb", "emb2"], [0.3, 0.7]).select("u", "v", r("cos"))


def _halves(spark, sf) -> list[DataFrame]:
    return [s.select("nid", F.slice("emb", 1, 32).alias("emb"), F.slice("emb", 33, 32).alias("emb2")) for s in sides(spark, sf)]


def weighted_cosine_lsh(spark, sf):
    out = candidates.candidate_pairs(*_halves(spark, sf), COSINE, ["emb", "emb2"], [0.3, 0.7], 2, 3, seed=PLANE_SEED)
    return out.select("u", "v", r("cos"))


def channel_mixtures(spark, sf):
    """Both channels' cosines, taken once, in three mixtures."""
    both = candidates.cosine_pairs(*_halves(spark, sf), COSINE, ["emb", "emb2"], any_channel=True)
    shares = F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.75)))).alias("share")
    rows = both.select("u", "v", shares, "cos_0", "cos_1").withColumn("cos", F.col("share") * F.col("cos_0") + (1 - F.col("share")) * F.col("cos_1"))
    return rows.where(F.col("cos") >= COSINE).select("share", "u", "v", r("cos"))


def rescore_edges(spark, sf):
    return scored(spark, sf).select("u", "v", *(r(c) for c in ("cos", "sim_conf", "degree_conf", "score")))


def _matched(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rank").cast("long").alias("rank"), "u", "v", r("score"))


def match_shm(spark, sf):
    return _matched(matching.shm(scored(spark, sf), 100))


def match_smm(spark, sf):
    return _matched(matching.smm(scored(spark, sf), 100))


def match_mwm(spark, sf):
    # a lower threshold, so that a matching of the whole smaller side exists
    return _matched(matching.mwm(scoredpairs.ScoredPairs(*sides(spark, sf), 0.0), 100))


def _truth(spark, sf, matches: DataFrame) -> DataFrame:
    """The true ones of the matches: both nodes have one label."""
    u, v = (s.select(F.col("nid").cast("string").alias(key), F.col("label").alias("class")) for s, key in zip(sides(spark, sf), ("u_key", "v_key")))
    return evaluate.class_truth(matches, u, v)


def _named_matches(spark, sf):
    return stored(matching.shm(scored(spark, sf), 100).select("rank", F.col("u").cast("string").alias("u_key"), F.col("v").cast("string").alias("v_key")))


def true_matches(spark, sf):
    found = _named_matches(spark, sf)
    return evaluate.true_matches(found, _truth(spark, sf, found))


def precision_at_k(spark, sf):
    found = _named_matches(spark, sf)
    out = evaluate.precision_at(found, _truth(spark, sf, found), KS)
    return out.select(F.col("k").cast("long").alias("k"), F.col("tp").cast("long").alias("tp"), r("precision"))


# ---------------------------------------------------------------- whole runs


def _saved(spark, sf, folder: str) -> tuple[str, Settings]:
    settings = Settings("graph_save_calculate", threshold=THRESHOLD, node_features="egonet1", qgram_attributes=("p_name",), results_path=f"{folder}/results", node_matching_threshold=0.5, weight_list=(0.5,), num_top_pairs=KS)
    tables = pipeline.build_graph(part(spark, sf), encoded_records(spark, sf), settings)
    return store.save_graph(f"{folder}/graphs", tables, store.GraphMeta(0, THRESHOLD, node_features="egonet1")), settings


def _folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/simloom-run-{uuid.uuid4().hex}"


def graph_store(spark, sf):
    """The edges of both sides of a saved graph; a node's side is its id's last bit."""
    path, _ = _saved(spark, sf, _folder(spark))
    tables, _ = store.load_graph(spark, path)
    side = F.when(F.col("src") % 2 == 0, "u").otherwise("v").alias("side")
    return tables["edges"].select(side, F.floor(F.col("src") / 2).cast("long").alias("src"), F.floor(F.col("dst") / 2).cast("long").alias("dst"), r("weight"))


def alignment_run(spark, sf):
    path, settings = _saved(spark, sf, _folder(spark))
    grids = {"graphwave": {"sample_points": [(0, 100, 25)], "scales": [None], "order": [30]}}
    out = pipeline.graph_load(spark, path, settings, grids)
    return out.select("technique", "weight", F.col("k").cast("long").alias("k"), F.col("tp").cast("long").alias("tp"), r("precision"))


#: What the result rows below hold besides precisions.
SINK_VALUES = {
    "file": "graphs/part", "dataset": "graphs", "record_count": 0, "threshold": THRESHOLD, "removed_records_plain": 0.1, "removed_records_encoded": 0.2, "node_features": "fast", "no_matches": 100,
    "graph_matching_tech": "shm", "lsh_count_nm": 2, "lsh_size_nm": 3, "cos_sim_threshold": COSINE, "hyperplane_count": 1024, "min_comp_size": 3, "scaler": "standard", "vidanage_weights": (0.6, 0.3, 0.1), "lsh_count_blk": 0, "lsh_size_blk": 0,
}
TECHNIQUE_VALUES = {
    "graphwave": {"type": "weighted", "weight": 1.0, "scales": [0.5, 2.0], "sample_points_linspace": (0, 100, 50), "order_approx": 30},
    "graphsage": {"weight": 0.75, "layers": (256, 128), "num_samples": (10, 5), "number_of_walks": 1, "length": 5, "batch_size": 512, "epochs": 1},
    "deepgraphinfomax": {"weight": 0.5, "layers": (512, 64), "activation": ("relu", "tanh"), "epochs": 20},
}


def result_sink(spark, sf):
    """Every column of two rows of the features' result table."""
    folder = _folder(spark)
    row = results.result_row(stored(precision_at_k(spark, sf)), {"ks": KS} | SINK_VALUES, "features")
    for _ in range(2):
        results.append(row, folder, "features_results")
    return results.read_results(spark, folder, "features_results")


def result_sink_techniques(spark, sf):
    """Every column of a row of each embedding's result table."""
    folder, out = _folder(spark), None
    found = stored(precision_at_k(spark, sf))
    for technique, more in TECHNIQUE_VALUES.items():
        results.append(results.result_row(found, {"ks": KS} | SINK_VALUES | more, technique), folder, f"{technique}_results", "csv")
        rows = results.read_results(spark, folder, f"{technique}_results", "csv").withColumn("technique", F.lit(technique))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("technique", *(c if not c.startswith("precision_") else F.col(c).cast("double").alias(c) for c in out.columns if c != "technique"))


def timing_sink(spark, sf):
    folder = _folder(spark)
    for k, name in enumerate(("fast", "all", "fast")):
        results.append_timing(spark, folder, k, THRESHOLD, name, 1.5 * k)
    return spark.read.parquet(f"{folder}/performance/nf")


NAMES = """head_slice tail_slice sample_exact csv_scan dataset_names dedup_node_count ground_truth ground_truth_all_rows side_ids bigrams bigrams_padded murmur_positions bloom_positions
bloom_popcount bloom_decode hash_count_estimate qgram_estimates sim_edges_plain sim_edges_wide sim_edges_all_pairs sim_edges_encoded
lsh_block_keys block_stats sim_edges_blocked components filter_small_components edge_weight_stats degree_centrality egonet histo_1hop
histo_2hop betweenness features_all scale_standard scale_minmax heat_kernel graphwave_embedding graphwave_unweighted sage_mean_propagate gcn_propagate
graphsage_embedding dgi_embedding hyperplane_buckets cosine_candidates cosine_candidates_lsh weighted_cosine weighted_cosine_lsh channel_mixtures rescore_edges match_shm match_smm
match_mwm true_matches precision_at_k graph_store alignment_run result_sink result_sink_techniques timing_sink""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
