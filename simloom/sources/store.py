"""Saved graphs: a directory of Parquet tables and meta.json. Nothing is ever unpickled."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nodes", "edges", "features", "matches")


@dataclass(frozen=True)
class GraphMeta:
    """What a graph was made with; its name holds the same in short."""

    record_count: int = 0
    threshold: float = 0.4
    removed_plain: float = 0.0
    removed_encoded: float = 0.0
    min_comp_size: int = 3
    node_features: str = "all"
    node_count: bool = False
    scaler: str = ""
    lsh_count: int = 0
    lsh_size: int = 0


_SCALERS = {"minmax": "_minmax", "standard": "_std", "": ""}
_NAME = re.compile(
    r"c(?P<record_count>-?\d+)_t(?P<threshold>[\d.]+)(?:_comp(?P<min_comp_size>\d+))?_r(?P<removed_plain>[\d.]+)(?:e(?P<removed_encoded>[\d.]+))?"
    r"(?:_lshc(?P<lsh_count>\d+))?(?:_lshs(?P<lsh_size>\d+))?_(?P<node_features>fast|egonet1|egonet2|all|histo)(?P<node_count>_nodeCount)?(?P<scaler>_minmax|_std)?$"
)


def dataset_name(meta: GraphMeta) -> str:
    """A name such as c1000_t0.4_comp3_r0.0e0.0_all_std."""
    parts = [f"c{meta.record_count}", f"t{meta.threshold}"]
    parts += [f"comp{meta.min_comp_size}"] * bool(meta.min_comp_size)
    parts.append(f"r{meta.removed_plain}e{meta.removed_encoded}")
    parts += [f"lshc{meta.lsh_count}", f"lshs{meta.lsh_size}"] if meta.lsh_size else []
    return "_".join([*parts, meta.node_features]) + "_nodeCount" * meta.node_count + _SCALERS[meta.scaler]


def parse_name(name: str) -> GraphMeta:
    """Inverse of dataset_name. Older names have one removed share for both sides, and histo for all."""
    m = _NAME.fullmatch(name)
    if not m:
        raise ValueError(f"{name!r} isn't a dataset's name")
    x = m.groupdict()
    return GraphMeta(
        int(x["record_count"]), float(x["threshold"]), float(x["removed_plain"]), float(x["removed_encoded"] or x["removed_plain"]), int(x["min_comp_size"] or 0),
        "all" if x["node_features"] == "histo" else x["node_features"], bool(x["node_count"]), {v: k for k, v in _SCALERS.items()}[x["scaler"] or ""], int(x["lsh_count"] or 0), int(x["lsh_size"] or 0),
    )


def save_graph(folder: str, tables: dict[str, DataFrame], meta: GraphMeta) -> str:
    """Write the tables under the graph's name in the folder; a graph of that name is replaced."""
    path = f"{folder.rstrip('/')}/{dataset_name(meta)}"
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark = tables["edges"].sparkSession
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
    return path


def load_graph(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], GraphMeta]:
    meta = json.loads(spark.read.text(f"{path}/meta.json").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, GraphMeta(**meta)
