"""Rules read from YAML on the driver: small, and turned into constants or small tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators.mapping import USUAL, Profile

#: Keys that a mapping profile must have.
REQUIRED = ("heading_map", "paragraph_map", "list_map", "note_map", "figure_map", "table_map")


def load_mapping(path: str, required: tuple[str, ...] = REQUIRED) -> dict[str, Any]:
    """A mapping profile; raises ValueError where keys are missing."""
    import yaml

    with open(path, encoding="utf-8") as file:
        rules = yaml.safe_load(file) or {}
    if missing := sorted(set(required) - set(rules)):
        raise ValueError(f"the mapping rules lack: {', '.join(missing)}")
    return rules


def profile(rules: dict[str, Any]) -> Profile:
    """What the mapper takes from a mapping profile; what that leaves out is as usual."""
    signals = tuple(str(x).lower() for x in (rules.get("topic_type_signals") or {}).get("reference", USUAL.signals))
    return Profile(signals, rules.get("ui_path_pattern", USUAL.path), rules.get("topic_type", USUAL.default_type), rules.get("fallback_element", USUAL.fallback))


def load_quality(path: str) -> dict[str, Any]:
    """Quality rules; an unreadable file gives none."""
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            return yaml.safe_load(file) or {}
    except (OSError, yaml.YAMLError):
        return {}


def brand_table(spark: SparkSession, rules: dict[str, Any]) -> DataFrame:
    """brand, place, keyword: one row a keyword."""
    rows = [(brand, k, str(word)) for k, (brand, meta) in enumerate((rules.get("brand_rules") or {}).items()) for word in (meta or {}).get("keywords", [])]
    return spark.createDataFrame(rows, "brand string, place int, keyword string")
