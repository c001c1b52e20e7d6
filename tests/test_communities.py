"""Leiden communities on graphs with known ones."""

import numpy as np
import pytest

from sparkmat.operators import network as N
from sparkmat.operators.communities import cluster_network


def planted(groups=6, size=12, seed=1):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (0.7 if a // size == b // size else 0.02)]


def graph(spark, pairs):
    return spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "src long, dst long, weight double")


def labels(df):
    return {r.node: r.label for r in df.collect()}


def test_planted_groups(spark):
    g = graph(spark, planted())
    want = {i: i // 12 * 12 for i in range(72)}
    found = cluster_network(g)
    assert labels(found) == want
    mixed = spark.createDataFrame([(i, i % 2) for i in range(72)], "node long, label long")
    best = N.modularity(g, found).first().modularity
    assert N.modularity(g, cluster_network(g, initial=mixed, iterations=5)).first().modularity >= 0.9 * best > N.modularity(g, mixed).first().modularity
    assert labels(cluster_network(g, objective="CPM", resolution=0.3)) == want
    assert N.modularity(g, found).first().modularity >= N.modularity(g, N.cluster(g)).first().modularity - 1e-9
    assert len(set(labels(cluster_network(g, most_edges=60)).values())) <= 6


def test_communities_are_connected_and_errors(spark):
    pairs = planted(4, 8, 3)
    at = labels(cluster_network(graph(spark, pairs), resolution=1.5))
    for c in set(at.values()):
        inside, seen = {i for i in at if at[i] == c}, {c}
        while more := {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in seen and y in inside - seen}:
            seen |= more
        assert seen == inside
    with pytest.raises(ValueError):
        cluster_network(graph(spark, pairs), objective="potts")
    with pytest.raises(ValueError):
        cluster_network(spark.createDataFrame([(0, 1, float("nan"))], "src long, dst long, weight double"))
    assert cluster_network(spark.createDataFrame([], "src long, dst long, weight double")).count() == 0
