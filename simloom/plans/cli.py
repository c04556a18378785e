"""The command line: python -m simloom.plans.cli MODE ..."""

from __future__ import annotations

import argparse
from dataclasses import fields

from simloom.plans.settings import FEATURE_SETS, Settings, fraction, to_shares

_SCALERS = {"": "", "minmax": "minmax", "minmaxscaler": "minmax", "standard": "standard", "standardscaler": "standard"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="simloom", description="Similarity graphs of plain and encoded records, and their alignment.")
    modes = top.add_subparsers(dest="mode", required=True)
    save, load, both = (modes.add_parser(x) for x in ("graph_save", "graph_load", "graph_save_calculate"))
    for p in (save, both):
        p.add_argument("plain_file")
        p.add_argument("encoded_file")
        p.add_argument("threshold", type=fraction)
        p.add_argument("--graph_path", default="graphs")
        p.add_argument("--remove_frac_plain", type=fraction, default=0.0)
        p.add_argument("--remove_frac_encoded", type=fraction, default=0.0)
        p.add_argument("--record_count", type=int, default=0, help="first rows if positive, last if negative, 0: all")
        p.add_argument("--node_features", choices=FEATURE_SETS, default="all")
        p.add_argument("--node_count", action="store_true")
        p.add_argument("--nf_scaled", choices=sorted(_SCALERS), default="")
        p.add_argument("--min_comp_size", type=int, default=3)
        p.add_argument("--padding", action="store_true")
        p.add_argument("--lsh_size_blocking", type=int, default=0)
        p.add_argument("--lsh_count_blocking", type=int, default=1)
        p.add_argument("--qgram_attributes", nargs="+", default=["first_name", "last_name"])
        p.add_argument("--encoded_attr", default="base64_bf")
    load.add_argument("saved_graph")
    load.add_argument("--min_comp_size", type=int, default=0)
    for p in (load, both):
        p.add_argument("--results_path", default="results")
        p.add_argument("--lsh_size_node_matching", type=int, default=0)
        p.add_argument("--lsh_count_node_matching", type=int, default=1)
        p.add_argument("--node_matching_tech", choices=("shm", "mwm", "smm"), default="shm")
        p.add_argument("--weight_list", nargs="+", type=fraction, default=list(Settings.weight_list))
        p.add_argument("--graphwave_sg_lib", action="store_true", dest="graphwave_unweighted")
        p.add_argument("--hp_config_file", default="")
        p.add_argument("--scaler", choices=sorted(_SCALERS), default="standard")
        p.add_argument("--num_top_pairs", nargs="+", type=int, default=list(Settings.num_top_pairs))
        p.add_argument("--node_matching_threshold", type=fraction, default=0.9)
        p.add_argument("--vidanage_weights", nargs=3, type=float, default=list(Settings.vidanage_weights))
    return top


def parse(argv: list[str] | None = None) -> Settings:
    x = vars(parser().parse_args(argv))
    for name in ("nf_scaled", "scaler"):
        if name in x:
            x[name] = _SCALERS[x[name]]
    if "vidanage_weights" in x:
        x["vidanage_weights"] = to_shares(x["vidanage_weights"])
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k in known})


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from simloom.plans import pipeline

    settings = parse(argv)
    spark = SparkSession.builder.appName("simloom").getOrCreate()
    out = pipeline.run(spark, settings)
    if out is not None:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
