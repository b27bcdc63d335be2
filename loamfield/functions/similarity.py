"""String and set similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def jaro(a: str, b: str) -> float:
    """Jaro similarity without prefix weight."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True))
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def set_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``both_empty`` where neither has elements."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_set(labels: Column) -> Column:
    """Distinct labels of an array, trimmed and in lower case, without blanks."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.lower(strip(x))), lambda x: x != ""))


def split_labels(cell: Column) -> Column:
    """Labels of a ``"; "``-joined cell; null and blank cells have none."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda x: strip(x)), lambda x: x != "")
