"""Fixpoints that need more rounds than a fixed number."""

import pytest

from sparkmat.operators import matrix as M
from sparkmat.operators import network as N


def test_filter_goes_on_until_nothing_goes(spark):
    """Cell i holds genes i and i + 1: with two of each asked, the chain is eaten from its ends; a dense block stays."""
    chain = [(i, i + d, 1.0) for i in range(30) for d in (0, 1)]
    block = [(100 + i, 100 + j, 1.0) for i in range(3) for j in range(3)]
    x = spark.createDataFrame(chain + block, "cell long, gene long, value double")
    got = {(r.cell, r.gene, r.value) for r in M.filter_masks(x, min_cells=2, min_genes=2).collect()}
    assert got == set(block)


def test_clusters_do_not_stop_early(spark):
    g = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(6) if abs(a - b) == 1], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        N.cluster(g, rounds=1)


def test_coreness_of_a_long_chain(spark):
    """The value 1 moves one node a round from each end."""
    g = spark.createDataFrame([(a, b, 1.0) for a in range(410) for b in (a - 1, a + 1) if 0 <= b < 410], "src long, dst long, weight double")
    assert {r.coreness for r in N.coreness(g).collect()} == {1}
