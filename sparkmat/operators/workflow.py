"""The whole workflow: archetypes, network, footprint, layouts and colours of a reduced matrix (cell, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.operators import decomposition as D
from sparkmat.operators import network as N
from sparkmat.operators.annotation import diffuse_columns


def vectors_of(t: DataFrame, key: str, width: int) -> DataFrame:
    """(cell, vec) of (key, label, value): missing labels are 0."""
    cols = [F.coalesce(F.sum(F.when(F.col("label") == i, F.col("value"))), F.lit(0.0)) for i in range(width)]
    return t.groupBy(F.col(key).alias("cell")).agg(F.array(*cols).alias("vec"))


def run_workflow(cells: DataFrame, k_min: int = 2, k_max: int = 30, rounds: int = 50, threshold: float = -3.0, min_observations: int = 2, algorithm: str = "k*nn", metric: str = "jsd", density: float = 1.0, k: int = 100, mutual: bool = True, method: str = "umap", epochs: int = 100, three: bool = True, seed: int = 0, **search) -> dict[str, DataFrame]:
    """Tables by name: H_stacked, H_merged, assigned_archetype, network, archetype_footprint, layout_2d[, layout_3d, colors].

    Archetypes of the rows scaled to absolute sum 1; a network of the stacked memberships; the merged memberships
    diffused over it (the footprint), whose standardised columns start the layout in the plane; that layout and the
    footprint's third column start the one in space, with half the epochs, from which the colours come.
    """
    if algorithm not in ("k*nn", "knn"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    a = D.action(cells, k_min, k_max, rounds, threshold, min_observations)
    stacked = N.cut(a.stacked_vectors())
    if algorithm == "knn":
        network = N.knn_network(stacked, k, metric, mutual, **search)
    else:
        network = N.kstar_network(stacked, density, metric, mutual, **search)
    network = N.cut(network)
    width = len(a.merged_w)
    scores = a.merged.select(F.col("cell").alias("node"), F.posexplode("vec").alias("label", "value"))
    footprint = N.cut(vectors_of(diffuse_columns(network, scores), "node", width))
    flat = N.layout(network, N.standard_start(_padded(footprint, 2), 2), epochs, seed=seed, method=method)
    out = {"H_stacked": stacked, "H_merged": a.merged, "assigned_archetype": a.assigned().select("cell", "assigned"), "network": network, "archetype_footprint": footprint, "layout_2d": flat}
    if three:
        third = _padded(footprint, 3).select(F.col("cell").alias("node"), F.col("vec")[2].alias("w"))
        warm = flat.join(third, "node").select(F.col("node").alias("cell"), F.array("x", "y", "w").alias("vec"))
        space = N.layout(network, N.standard_start(warm, 3), epochs // 2, seed=seed, method=method)
        out |= {"layout_3d": space, "colors": N.embedding_colors(space.select(F.col("node").alias("cell"), F.array("x", "y", "z").alias("vec")))}
    return out


def _padded(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.select("cell", F.concat("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))
