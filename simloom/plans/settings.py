"""Settings as frozen values, and parameter grids of the embeddings."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import islice

#: Default parameters. Lists of one grid have equal lengths and are read in step.
DEFAULT_GRID = {
    "graphsage": {"layers": [[256, 128]], "num_samples": [[10, 5]], "epochs": [1]},
    "deepgraphinfomax": {"layers": [[512]], "activation": [["relu"]], "epochs": [20]},
    "graphwave": {"sample_points": [(0, 100, 50)], "scales": [None], "order": [30]},
}
FEATURE_SETS = ("fast", "egonet1", "egonet2", "all")
DEFAULT_WEIGHTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def fraction(text: str | float) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise ValueError(f"{text} isn't between 0 and 1")
    return x


def to_shares(weights) -> tuple[float, ...]:
    """Weights that aren't negative over their sum."""
    total = sum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights are not negative and not all 0")
    return tuple(w / total for w in weights)


@dataclass(frozen=True)
class GraphSage:
    layers: tuple[int, ...] = (256, 128)
    num_samples: tuple[int, ...] = (10, 5)
    number_of_walks: int = 1
    length: int = 5
    batch_size: int = 512
    epochs: int = 10

    technique = "graphsage"


@dataclass(frozen=True)
class DeepGraphInfomax:
    layers: tuple[int, ...] = (512,)
    activation: tuple[str, ...] = ("relu",)
    epochs: int = 20

    technique = "deepgraphinfomax"


@dataclass(frozen=True)
class GraphWave:
    sample_points: tuple[float, float, int] = (0, 100, 50)
    scales: tuple[float, ...] | None = None
    order: int = 30
    weighted: bool = True

    technique = "graphwave"


_KINDS = {k.technique: k for k in (GraphWave, DeepGraphInfomax, GraphSage)}


def describe(settings) -> str:
    return settings.technique + ": " + ", ".join(f"{f.name}={getattr(settings, f.name)}" for f in fields(settings))


def grid(kind: str, lists: dict[str, list]) -> Iterator:
    """One setting for each place in the lists, lazily; what has no list keeps its default."""
    if len({len(x) for x in lists.values()}) > 1:
        raise ValueError("the lists of a grid have equal lengths")
    make = _KINDS[kind]
    frozen = lambda x: tuple(x) if isinstance(x, list) else x
    for values in zip(*lists.values()):
        yield make(**{k: frozen(v) for k, v in zip(lists, values)})


#: The names of lists in files that have one dict for each technique, and ours.
LIST_NAMES = {
    "LAYER_STRUCTURES_LIST": "layers",
    "EPOCHS_LIST": "epochs",
    "NUM_SAMPLES_LIST": "num_samples",
    "NUM_WALKS_LIST": "number_of_walks",
    "LENGTH_LIST": "length",
    "BATCH_SIZE_LIST": "batch_size",
    "ACTIVATION_FUNC_LIST": "activation",
    "SAMPLE_PCT_LIST": "sample_points",
    "SCALES_LIST": "scales",
    "DEGREE_LIST": "order",
}


def load_grid(path: str) -> dict[str, dict[str, list]]:
    """The parameter grids of a Python file that the user names.

    Either one dict GRID by technique, or a dict of lists for each: graphsage_settings,
    deepgraphinfomax_settings and graphwave_settings, whose scales may be ["auto"].
    """
    spec = importlib.util.spec_from_file_location("simloom_grid", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if hasattr(module, "GRID"):
        return module.GRID
    found = {kind: getattr(module, f"{kind}_settings") for kind in _KINDS if hasattr(module, f"{kind}_settings")}
    if not found:
        raise ValueError(f"{path} has neither GRID nor settings of {', '.join(_KINDS)}")
    out = {kind: {LIST_NAMES.get(k, k): list(v) for k, v in lists.items()} for kind, lists in found.items()}
    for lists in out.values():
        if "scales" in lists:
            lists["scales"] = [None if x in ("auto", ["auto"]) else x for x in lists["scales"]]
    return out


def embeddings(grids: dict[str, dict[str, list]], most: int | None = None) -> Iterator:
    """All settings, technique by technique."""
    return islice((s for kind in _KINDS if kind in grids for s in grid(kind, grids[kind])), most)


@dataclass(frozen=True)
class Settings:
    """Everything a run needs; the command line fills it in."""

    mode: str
    plain_file: str = ""
    encoded_file: str = ""
    graph_path: str = "graphs"
    saved_graph: str = ""
    threshold: float = 0.4
    remove_frac_plain: float = 0.0
    remove_frac_encoded: float = 0.0
    record_count: int = 0
    node_features: str = "all"
    node_count: bool = False
    nf_scaled: str = ""
    min_comp_size: int = 3
    padding: bool = False
    lsh_size_blocking: int = 0
    lsh_count_blocking: int = 1
    qgram_attributes: tuple[str, ...] = ("first_name", "last_name")
    encoded_attr: str = "base64_bf"
    results_path: str = "results"
    lsh_size_node_matching: int = 0
    lsh_count_node_matching: int = 1
    node_matching_tech: str = "shm"
    weight_list: tuple[float, ...] = DEFAULT_WEIGHTS
    graphwave_unweighted: bool = False
    hp_config_file: str = ""
    scaler: str = "standard"
    num_top_pairs: tuple[int, ...] = (10, 50, 100, 500, 1000)
    node_matching_threshold: float = 0.9
    vidanage_weights: tuple[float, float, float] = (0.6, 0.3, 0.1)
    hyperplanes: int = 1024
    seed: int = 3
