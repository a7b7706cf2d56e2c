"""Case-insensitive literal containment.  Both sides are expected in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(lowered: Column, needle: Column) -> Column:
    """An empty needle is contained in every text."""
    return F.contains(lowered, needle)


def any_contains(lowered: Column, needle: Column) -> Column:
    return F.exists(lowered, lambda x: F.contains(x, needle))


def count_containing(lowered: Column, needle: Column) -> Column:
    return F.size(F.filter(lowered, lambda x: F.contains(x, needle)))
