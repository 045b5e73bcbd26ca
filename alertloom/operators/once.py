"""Evaluate expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for regex-heavy expressions.

    The optimizer copies a projected expression into every later filter and projection that names
    it, so a pattern could run many times per row. A generator that yields exactly one row per
    input row is never copied; it still runs inside whole-stage code.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
