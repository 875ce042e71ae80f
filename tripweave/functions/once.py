"""Keep an expensive expression from being copied into every place that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions run exactly once per row.

    The optimizer inlines a projected expression into each filter and projection above it, which
    multiplies nested expressions. A one-element generator is a boundary it does not cross; it stays
    inside code generation and moves no data.
    """
    fresh = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, fresh)
