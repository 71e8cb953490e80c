"""Settings with where each value came from: a field's own block, the project's file, or the default."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import yaml

DEFAULTS: dict[str, Any] = {
    "require_leaf": True, "allow_abstain": True, "max_label_share": 0.5, "abstain_rate": (0.01, 0.20), "max_drift_pp": 0.10, "min_stability": 0.90, "min_words": None, "max_words": None,
    "min_specificity": 0.90, "max_copy_ratio": 0.5, "min_claim_support": 0.95, "require_verbatim": False, "min_grounding": 0.95, "ambiguous_above": 1, "min_cross_field_agreement": 0.90,
    "bootstrap_resamples": 1000, "judge_temperature": 0, "judge_max_tokens": 60, "judge_retries": 3, "judge_approval_warn": (0.15, 0.85), "judge_approval_stop": (0.02, 0.98),
    "parse_failure_warn": 0.02, "parse_failure_stop": 0.05, "minority_class_min_items": 30, "minority_class_min_share": 0.05, "effective_votes_warn": 0.5, "min_n_ranking": 200,
    "min_n_distribution": 200, "min_n_per_label": 30, "fuzzy_pair_report": 5, "panel_sample": 300, "audit_rate": 0.10,
}


class BadSetting(ValueError):
    """A setting that does not exist or has a value it cannot have."""


@dataclass(frozen=True)
class Resolved:
    value: Any
    source: str


def check(values: Mapping[str, Any]) -> None:
    for k, v in values.items():
        if k not in DEFAULTS:
            raise BadSetting(f"unknown setting {k}")
        d = DEFAULTS[k]
        if isinstance(d, bool) != isinstance(v, bool) and isinstance(d, bool):
            raise BadSetting(f"{k}: expected true or false")
        if isinstance(d, float) and not (isinstance(v, (int, float)) and 0 <= v <= 1):
            raise BadSetting(f"{k}: expected a share between 0 and 1")
        if isinstance(d, tuple) and not (len(v) == 2 and 0 <= v[0] <= v[1] <= 1):
            raise BadSetting(f"{k}: expected a lower and an upper share")


def resolve(name: str, block: Mapping[str, Any] | None = None, project: Mapping[str, Any] | None = None) -> Resolved:
    if name not in DEFAULTS:
        raise BadSetting(f"unknown setting {name}")
    for source, layer in (("field", block), ("settings", project)):
        if layer and name in layer:
            check({name: layer[name]})
            return Resolved(layer[name], source)
    return Resolved(DEFAULTS[name], "default")


def resolved(layers: Mapping[str, Mapping[str, Any]], names: Iterable[str]) -> list[tuple[str, float, str]]:
    """(name, value, source) of numeric settings, from the blocks `field` and `settings` or the default."""
    out = []
    for n in names:
        r = resolve(n, layers.get("field"), layers.get("settings"))
        out.append((n, float(r.value), r.source))
    return out


def load(text: str) -> dict[str, Any]:
    values = yaml.safe_load(text) or {}
    check(values)
    return values
