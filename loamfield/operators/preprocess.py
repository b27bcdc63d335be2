"""Entries cleaned, measured and freed of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CleaningRules, with_clean
from ..sources.ingest import first_of_each

# The shortest and longest text kept.
SHORTEST, LONGEST = 10, 10_000


def preprocessed(entries: DataFrame, rules: CleaningRules = CleaningRules(), shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Entries with cleaned texts of a length within bounds, of equal texts the first by row_ord.

    Null and blank texts go.  Bounds in the wrong order are swapped.
    """
    low, high = sorted((shortest, longest))
    rows = with_clean(entries.where(F.col("std_text").rlike(r"\S")), "std_text", rules)
    return first_of_each(rows.where(F.char_length("std_text").between(low, high)), "std_text")
