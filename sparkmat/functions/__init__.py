"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_raw(c: Column) -> Column:
    """10 ** c - 1; NaN stays NaN."""
    return F.when(F.isnan(c), c).otherwise(F.pow(F.lit(10.0), c) - 1)


def log_of(c: Column, kind: str) -> Column:
    """log, log2 or log10 with 0 taken as 1."""
    if kind not in ("log", "log2", "log10"):
        raise ValueError(f"unknown transform {kind!r}")
    v = F.when(c == 0, 1.0).otherwise(c)
    return {"log": F.log, "log2": F.log2, "log10": F.log10}[kind](v)


def quantile_label(side: str, q: float) -> str:
    """Column name of a quantile, such as neg_0.99."""
    return f"{side}_{q:g}"
