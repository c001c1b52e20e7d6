"""Normalisation that is kept as a recipe: factors by cell and a fingerprint of the matrix they were taken from."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.operators.network import cut


class StaleTransform(ValueError):
    """The matrix is not the one that the factors were taken from."""


def evenly_spaced(n: int, k: int) -> list[int]:
    """At most ``k`` different places of 0 .. n - 1, ends included."""
    if n <= k:
        return list(range(n))
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]


def fingerprint(x: DataFrame, group: str = "X") -> dict:
    """Shape, number of entries and types of a matrix (cell, gene, value)."""
    r = x.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("cell").alias("cells"), F.count_distinct("gene").alias("genes")).first()
    return {"group": group, "nnz": r.nnz, "cells": r.cells, "genes": r.genes, "types": dict(x.select("cell", "gene", "value").dtypes)}


class LazyTransform:
    """log1p(value * target / total of the cell) / ln(base), joined and computed where it is read."""

    def __init__(self, x: DataFrame, target: float, log_base: float | None, samples: int, group: str):
        self.target, self.log_base, self.group = target, log_base, group
        total = x.groupBy("cell").agg(F.sum("value").cast("double").alias("total"))
        self.factors = cut(total.select("cell", "total", F.when(F.col("total") > 0, target / F.col("total")).otherwise(0.0).alias("factor")))
        self.print = fingerprint(x, group)
        places = evenly_spaced(self.print["cells"], samples)
        # Evenly spaced ids stand for evenly spaced rows; percentiles of the ids are some cells' own.
        share = [p / max(self.print["cells"] - 1, 1) for p in places]
        picked = self.factors.agg(F.percentile_approx("cell", F.array(*map(F.lit, share)), 1_000_000).alias("p")).first().p if places else []
        self.samples = {r.cell: r.total for r in self.factors.where(F.col("cell").isin(list(picked or []))).collect()}
        self.valid_for: set[int] = set()

    @property
    def key(self) -> str:
        notes = self.print | {"target": self.target, "log_base": self.log_base, "samples": sorted(self.samples.items())}
        return hashlib.sha256(json.dumps(notes, sort_keys=True).encode()).hexdigest()[:24]

    def validate(self, x: DataFrame) -> None:
        """Once for each frame: the fingerprint, and the sampled cells' totals to 1e-8."""
        if id(x) in self.valid_for:
            return
        if fingerprint(x, self.group) != self.print:
            raise StaleTransform("shape, entries or types of the matrix have changed")
        now = {r.cell: r.t for r in x.where(F.col("cell").isin(list(self.samples))).groupBy("cell").agg(F.sum("value").cast("double").alias("t")).collect()}
        if any(not math.isclose(now.get(c, 0.0), t, rel_tol=1e-8, abs_tol=1e-8) for c, t in self.samples.items()):
            raise StaleTransform("totals of sampled cells have changed")
        self.valid_for.add(id(x))

    def apply(self, x: DataFrame, validate: bool = True) -> DataFrame:
        """``x`` with transformed values; a cell without a positive total has 0."""
        if validate:
            self.validate(x)
        value = F.log1p(F.col("value") * F.col("factor"))
        value = value if self.log_base is None else value / math.log(self.log_base)
        return x.join(self.factors.select("cell", "factor"), "cell").select("cell", "gene", value.alias("value"))


def create_lazy_transform(x: DataFrame, target: float = 1e4, log_base: float | None = None, pseudocount: float = 1.0, samples: int = 16, group: str = "X") -> LazyTransform:
    """Only a pseudocount of 1 leaves implicit zeros at 0, so it is the only one that can wait."""
    if pseudocount != 1.0:
        raise ValueError("a lazy transform needs pseudocount 1")
    if log_base is not None and (log_base <= 0 or log_base == 1):
        raise ValueError("the base of a logarithm is positive and not 1")
    return LazyTransform(x, target, log_base, samples, group)
