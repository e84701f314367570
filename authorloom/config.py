"""Settings and their checks. Weights, thresholds and m/u values are fixed values of the method."""

from __future__ import annotations

import copy
import json
from pathlib import Path

import yaml

from .exceptions import ConfigurationError

WEIGHTS = {"name": 0.5, "coauthors": 0.3, "journals": 0.2}
SIMILARITY_THRESHOLD = 0.85
ACCEPT, REJECT = 0.90, 0.20
MAX_CANDIDATES, AFFILIATION_BUCKET = 100, 20
MAX_AFFECTED = 100
SALT = "default_salt_change_in_production"

#: Fixed values: (m, u) of each feature's bins.
MU = {
    "name": {"exact": (0.95, 0.01), "high": (0.80, 0.05), "medium": (0.40, 0.15), "low": (0.10, 0.30), "none": (0.01, 0.70)},
    "orcid": {"match": (0.99, 0.001), "missing": (0.50, 0.70)},
    "coauthor": {"high": (0.70, 0.05), "medium": (0.40, 0.15), "low": (0.20, 0.30), "none": (0.10, 0.60)},
    "journal": {"high": (0.65, 0.10), "medium": (0.35, 0.20), "low": (0.20, 0.35), "none": (0.10, 0.50)},
    "affiliation": {"exact": (0.90, 0.02), "high": (0.70, 0.08), "medium": (0.40, 0.20), "low": (0.15, 0.35), "none": (0.05, 0.60)},
    "chinese_name": {"high": (0.85, 0.10), "medium": (0.50, 0.25), "low": (0.25, 0.40), "unknown": (0.50, 0.50)},
}
#: Lowest similarity of each bin, highest first; "low" needs more than 0.
BINS = {
    "name": [("exact", 0.95), ("high", 0.75), ("medium", 0.50)],
    "coauthor": [("high", 0.50), ("medium", 0.20)],
    "journal": [("high", 0.50), ("medium", 0.20)],
    "affiliation": [("exact", 0.90), ("high", 0.70), ("medium", 0.40)],
}
#: Names used by calibrated tables for the features above.
CALIBRATED_NAMES = {"name_similarity": "name", "orcid_match": "orcid", "coauthor_overlap": "coauthor", "venue_similarity": "journal", "affiliation_similarity": "affiliation"}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights as given; ConfigurationError unless non-negative with sum 1 (within 1e-6)."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ConfigurationError(f"weights must be non-negative and sum to 1: {weights}")
    return weights


def check_thresholds(accept: float, reject: float, probability: bool = False) -> None:
    """accept > reject; both in [0, 1] if scores are probability-like (log-likelihood ratios are not)."""
    if not accept > reject:
        raise ConfigurationError(f"accept ({accept}) must exceed reject ({reject})")
    if probability and not (0 <= reject <= 1 and 0 <= accept <= 1):
        raise ConfigurationError("thresholds must lie in [0, 1]")


def check_limit(name: str, value: int) -> int:
    if value <= 0:
        raise ConfigurationError(f"{name} must be positive: {value}")
    return value


def engine_config(**given) -> dict:
    """The default settings with what is given, checked."""
    out = {"weights": dict(WEIGHTS), "threshold": SIMILARITY_THRESHOLD, "accept": ACCEPT, "reject": REJECT, "max_affected": MAX_AFFECTED, "max_candidates": MAX_CANDIDATES, "mode": "baseline"}
    if unknown := set(given) - set(out):
        raise ConfigurationError(f"unknown settings: {sorted(unknown)}")
    out |= given
    check_weights(out["weights"])
    check_thresholds(out["accept"], out["reject"])
    if not 0 <= out["threshold"] <= 1:
        raise ConfigurationError("threshold must lie in [0, 1]")
    if out["mode"] not in ("baseline", "fs"):
        raise ConfigurationError(f"mode must be baseline or fs: {out['mode']}")
    for name in ("max_affected", "max_candidates"):
        check_limit(name, out[name])
    return out


def mu_table(path: str | None = None) -> dict[str, dict[str, tuple[float, float]]]:
    """The built-in m/u table, or one from a JSON or YAML file with {feature: {bin: {m, u}}}.

    Features named as in calibrated tables are renamed. m and u must lie in [0, 1].
    """
    if path is None:
        return copy.deepcopy(MU)
    text = Path(path).read_text()
    raw = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    raw = raw.get("mu_table", raw.get("features", raw))
    out: dict = {}
    for feature, bins in raw.items():
        if not isinstance(bins, dict):
            continue
        bins = bins.get("bins", bins)
        got = {}
        for name, v in bins.items():
            if not isinstance(v, dict) or "m" not in v or "u" not in v:
                continue
            m, u = float(v["m"]), float(v["u"])
            if not (0 <= m <= 1 and 0 <= u <= 1):
                raise ConfigurationError(f"m and u of {feature}.{name} must lie in [0, 1]")
            got[name] = (m, u)
        if got:
            out[CALIBRATED_NAMES.get(feature, feature)] = got
    if not out:
        raise ConfigurationError(f"no m/u values in {path}")
    return out


def bins_config(path: str) -> dict[str, list[dict]]:
    """{feature: [{name, min, max} | {name, value} | {name, max_diff}]} from YAML, names checked."""
    raw = yaml.safe_load(Path(path).read_text())
    out = {k: v["bins"] for k, v in raw.items() if isinstance(v, dict) and "bins" in v}
    if any("name" not in b for bins in out.values() for b in bins):
        raise ConfigurationError("every bin needs a name")
    return out
