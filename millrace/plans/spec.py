"""Job settings: validation, dependencies and registries (SRC11, FIL7-FIL10, FN8, SPL11, UDF1-UDF5)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from millrace.functions.scalar import typed_value

#: Blocks of the run settings and their keys.
BLOCKS: dict[str, set[str]] = {
    "model_info": {"notes"},
    "dataset": {"dataset_file", "mode", "tasks", "feature_field", "id_field", "extra_desc", "descriptors", "fingerprints"},
    "preprocessing": {"featurizer", "ph", "phmodel", "tauto", "rdkit_desc"},
    "train_test_split": {"split_method", "n_splits", "strat_field", "frac_train", "frac_test", "from_file"},
    "train_val_split": {"split_method", "n_splits", "strat_field", "frac_train", "frac_test", "from_file"},
    "training": {
        "model_fn_str", "hyperparam_search", "n_iter", "selection_metric", "select_max_value", "early_stopping", "early_stopping_patience", "early_stopping_threshold",
        "epochs", "uncertainty", "save_model", "save_predictions", "calculate_ensemble_performance", "n_cpus",
    },
}
#: Blocks whose keys are the user's own names, and packaging blocks.
OPEN_BLOCKS = {"ext_datasets", "hyperparams", "trained_model", "training_data", "test_data", "output_options"}
DEFAULTS = {"hyperparam_search": "grid", "selection_metric": "loss", "select_max_value": False, "save_model": "refit", "save_predictions": "refit"}


def load_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """Run settings from a JSON file in any store that Spark reads, checked (SRC11)."""
    return checked_settings(json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def checked_settings(settings: dict[str, Any]) -> dict[str, Any]:
    """settings with defaults; an unknown block or key is an error, hyperparam_search_iterations is n_iter."""
    for block, keys in settings.items():
        if block in OPEN_BLOCKS:
            continue
        if block not in BLOCKS:
            raise ValueError(f"unknown block {block}")
        if not isinstance(keys, dict):
            raise ValueError(f"block {block} is no object")
    training = dict(settings.get("training", {}))
    if "hyperparam_search_iterations" in training:
        training["n_iter"] = training.pop("hyperparam_search_iterations")
    out = {**settings, "training": DEFAULTS | training}
    for block, known in BLOCKS.items():
        if unknown := {k for k in out.get(block, {}) if k != "_order"} - known:
            raise ValueError(f"unknown settings in {block}: {sorted(unknown)}")
    if out["training"]["hyperparam_search"] not in ("grid", "random"):
        raise ValueError("hyperparam_search is grid or random")
    return out


def name_value_pairs(arguments: list[str], default: Any = None) -> dict[str, Any]:
    """Alternating names and values; an odd number is an error (FIL10, FN8)."""
    if len(arguments) % 2:
        raise ValueError("names and values have to alternate")
    return {n: typed_value(v) if v else default for n, v in zip(arguments[::2], arguments[1::2], strict=True)}


def chosen_outputs(names: list[str] | None, registry: dict[str, Column]) -> list[str]:
    """Output columns: None for none, an empty list for all, unknown names ignored, order kept (FIL7)."""
    if names is None:
        return []
    return list(registry) if not names else [n for n in names if n in registry]


def closure(wanted: list[str], needs: dict[str, list[str]]) -> list[str]:
    """wanted and all it needs, needed ones first (FIL8); a cycle is an error."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_:
            raise ValueError(f"{name} needs itself")
        open_.add(name)
        for n in needs.get(name, []):
            visit(n)
        open_.discard(name)
        out.append(name)

    for name in wanted:
        visit(name)
    return out


@dataclass
class ScoreSpec:
    """A scoring job: derived columns with what they need, profiles and flags."""

    columns: dict[str, Column]
    needs: dict[str, list[str]] = field(default_factory=dict)
    profiles: dict[str, str | float] = field(default_factory=dict)
    flags: dict[str, Column] = field(default_factory=dict)

    def score(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """rows with the named columns and those they need; the profiled columns have to be among all (FIL9)."""
        for name in closure(names, self.needs):
            if name not in rows.columns:
                rows = rows.withColumn(name, self.columns[name])
        if missing := [p for p in self.profiles if p not in rows.columns]:
            raise ValueError(f"cannot profile {missing}: no such columns")
        return rows
