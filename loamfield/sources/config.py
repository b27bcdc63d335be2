"""Settings: defaults, dotted overrides, checks; and frameworks of constructs."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Defaults, and what a framework may say.
DEFAULTS: dict[str, Any] = {
    "data": {"source_type": "reddit", "table": None, "query": None, "test_sample": None, "seed": 42},
    "preprocessing": {"remove_urls": True, "remove_mentions": True, "remove_hashtags": False, "lowercase": False, "min_text_length": 10, "max_text_length": 10000},
    "analysis": {"mode": "codebook_collaborative", "min_theme_entries": 5, "batch_size": 15, "correlation_method": "dynamic"},
    "comparison": {"threshold": 0.75},
    "output": {"folder": "results", "formats": ["csv", "json"]},
}
MODES = ("reflexive_scaffold", "codebook_collaborative", "framework_applied")
STANCES, POLICIES = ("realist", "constructivist", "critical"), ("bracket", "extend", "revise")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the leaves of ``over``; null leaves of ``over`` don't count."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = copy.deepcopy(v)
    return out


def dotted(overrides: Mapping[str, Any]) -> dict[str, Any]:
    """``{"a.b": 1}`` as ``{"a": {"b": 1}}``."""
    out: dict[str, Any] = {}
    for key, value in overrides.items():
        at = out
        *path, last = key.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def loaded(text: str = "{}", overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Settings from JSON (or YAML where that can be read), with overrides, over the defaults; checked."""
    try:
        given = json.loads(text)
    except ValueError:
        import yaml

        given = yaml.safe_load(text) or {}
    out = merged(DEFAULTS, merged(given, dotted(overrides or {})))
    if out["analysis"]["mode"] not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if not 0 < out["comparison"]["threshold"] <= 1:
        raise ValueError("a threshold is over 0 and at most 1")
    return out


def framework(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """(id, name, description, indicators) of a framework's constructs, after checks of its fields."""
    for k in ("name", "stance", "anomaly_policy", "constructs"):
        if not spec.get(k):
            raise ValueError(f"a framework has {k}")
    if spec["stance"] not in STANCES or spec["anomaly_policy"] not in POLICIES:
        raise ValueError("the stance or the policy is unknown")
    ids = [c.get("id") for c in spec["constructs"]]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError("constructs have ids of their own")
    rows = [(c["id"], c.get("name", c["id"]), c.get("description"), list(c.get("indicators", []))) for c in spec["constructs"]]
    return spark.createDataFrame(rows, "id string, name string, description string, indicators array<string>")
