"""Shapes of what a coder or model answers, for ``from_json``; values outside a list are coerced, not trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_repair import json_value

# The fields of each kind of answer.
SEGMENT = "struct<code: string, code_type: string, text: string, start_char: int, end_char: int, rationale: string>"
SCHEMAS = {
    "coding": f"skip boolean, skip_reason string, segments array<{SEGMENT}>",
    "sentiment": "entries array<struct<id: string, sentiment_score: double, confidence: double, emotion_intensity: double, emotions: array<string>>>",
    "saturation": "saturated boolean, rationale string, confidence double",
    "clustering": "converged boolean, clusters array<struct<leaf_indices: array<int>, cluster_rationale: string>>",
    "labelling": "themes array<struct<index: int, name: string, description: string, keywords: array<string>>>",
    "theme_decision": "action string, target string, rationale string",
    "emergent_coding": "segments array<struct<index: int, code: string, rationale: string>>",
    "insight": "insights array<struct<title: string, text: string, evidence: array<string>>>",
    "metrics": "columns array<struct<column: string, primitives: array<string>, reliable_floor: int>>",
    "research_coverage": "facets array<struct<facet: string, level: string, themes: array<string>>>",
    "description": "description string",
    "relevance": "relevant boolean, reason string",
}


def answer(text: Column, kind: str) -> Column:
    """A model's answer as the struct of its kind; repaired where it can be, else null."""
    return json_value(text, SCHEMAS[kind])


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(default)
