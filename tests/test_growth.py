"""Steps whose memory, moves or rounds once grew faster than the input."""

import numpy as np
import pytest

from sparkmat.operators import network as N


def plan(df):
    return df._jdf.queryExecution().toString()


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cell long, vec array<double>")


@pytest.mark.parametrize("k", [3, 40])
def test_neighbours_are_whole_in_one_task(spark, k):
    """Before, all queries met each list's rows and the window ranked k rows for every list. Copies tie; smaller ids come first."""
    rng = np.random.default_rng(2)
    m = np.tile(rng.normal(size=(300, 4)), (8, 1))
    df = N.neighbours(vectors(spark, m), k, "ip", block=700)
    assert "CoGroup" not in plan(df) and "Window" not in plan(df)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert {(r.src, r.dst) for r in df.collect()} == {(i, int(j)) for i in range(len(m)) for j in near[i]}


def test_adaptive_neighbours_leave_the_task_as_prefixes(spark):
    v = vectors(spark, np.abs(np.random.default_rng(3).normal(size=(900, 6))))
    g = N.kstar_network(v, 2.0, "ip", mutual=False)
    assert "Window" not in plan(g)
    want = {(r.src, r.dst): r.weight for r in N.kstar_weights(N.neighbours(v, 150, "ip"), 2.0).collect()}
    got = {(r.src, r.dst): r.weight for r in g.collect()}
    assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in got) < 1e-9


def test_probed_lists(spark):
    m = np.random.default_rng(5).normal(size=(600, 5))
    got = N.neighbours(vectors(spark, m), 4, "l2", lists=6, probes=3, block=100).collect()
    d = np.linalg.norm(m[:, None] - m, axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(600) for j in np.argsort(d[i])[:4]}
    assert len(got) == 2400 and len({(r.src, r.dst) for r in got} & want) > 0.8 * 2400


def test_clusters_go_to_memory_once_they_fit(spark, monkeypatch):
    """Before, the graph was computed again for its check, and every level ran its rounds where it is although the next one fitted."""
    from sparkmat.operators import communities as C

    rng = np.random.default_rng(7)
    pairs = [(a, b) for a in range(120) for b in range(a) if rng.random() < (0.8 if a // 10 == b // 10 else 0.01)]
    g = spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "src long, dst long, weight double")
    rows, contracted = [], N.cut
    monkeypatch.setattr(N, "cut", lambda df: (rows.append(df.columns), contracted(df))[1])
    found = C.cluster_network(g, most_edges=400)
    assert {r.node: r.label for r in found.collect()} == {i: i // 10 * 10 for i in range(120)}
    assert sum(c == ["src", "dst", "weight"] for c in rows) == 2  # the graph and one contraction


def counted(spark, rows):
    """A graph that counts how many of its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(parts):
        for t in parts:
            seen.add(len(t))
            yield t

    return spark.createDataFrame(rows, "src long, dst long, weight double").coalesce(1).mapInPandas(run, "src long, dst long, weight double"), seen


RING = [(a, (a + d) % 30, 1.0) for a in range(30) for d in (1, -1)]


@pytest.mark.parametrize("name,most", [("pagerank", 1), ("layout", 2), ("propagate", 1), ("local_pagerank", 1), ("permuted", 1), ("annotate", 1), ("coreness", 1)])
def test_graphs_are_computed_once(spark, name, most):
    """Before, every round, or the nodes beside the edges, computed the graph anew."""
    from sparkmat.operators import annotation as A
    from sparkmat.operators import graph as G

    g, seen = counted(spark, RING)
    labels = spark.range(30).selectExpr("id AS node", "id % 3 AS label")
    values = spark.range(30).selectExpr("id AS node", "CAST(id % 7 AS DOUBLE) AS value")
    markers = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "label string, gene long, weight double")
    x = spark.range(60).selectExpr("id % 30 AS cell", "id DIV 30 AS gene", "CAST(id % 5 AS DOUBLE) AS value")
    run = {
        "pagerank": lambda: N.pagerank(g),
        "layout": lambda: N.layout(g, spark.range(30).selectExpr("id AS node", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y"), 3),
        "propagate": lambda: N.propagate_labels(g, labels),
        "local_pagerank": lambda: N.local_pagerank(g, labels),
        "coreness": lambda: N.coreness(g),
        "permuted": lambda: G.permuted_autocorrelation(g, values, 2),
        "annotate": lambda: A.annotate(x, markers, g, 2, "network")["labels"],
    }[name]
    assert run().count() > 0
    assert seen.value <= most * len(RING)


def test_network_statistic_smooths_a_column_a_label(spark, monkeypatch):
    """Before, a column of every marker gene was smoothed."""
    from sparkmat.operators import annotation as A

    g = spark.createDataFrame(RING, "src long, dst long, weight double")
    x = spark.range(180).selectExpr("id % 30 AS cell", "id DIV 30 AS gene", "CAST(id % 5 AS DOUBLE) AS value")
    markers = spark.range(6).selectExpr("id % 2 AS label", "id AS gene", "1.0D + id AS weight")
    smoothed, real = [], A.diffuse_columns
    monkeypatch.setattr(A, "diffuse_columns", lambda g, s, *a: (smoothed.append({r.label for r in s.collect()}), real(g, s, *a))[1])
    got = {(r.node, r.label): r.value for r in A.marker_stats(x, markers, g, 6, "network", rounds=2, ignore_baseline=True).collect()}
    assert smoothed == [{0, 1}]
    m, w, p = np.zeros((30, 6)), np.zeros((6, 2)), np.zeros((30, 30))
    for i in range(180):
        m[i % 30, i // 30] = i % 5
    for i in range(6):
        w[i, i % 2] = 1 + i
    for a, b, _ in RING:
        p[a, b] = 0.5
    want = m
    for _ in range(2):
        want = 0.85 * p @ want + 0.15 * m
    assert all(abs(got[i, j] - (want @ w)[i, j]) < 1e-9 for i in range(30) for j in range(2))


def test_rank_correlation_has_no_window_over_a_group(spark):
    """Before, five windows held a whole group in one task. Ties of y and a null group are kept."""
    from sparkmat.operators import annotation as A

    rng = np.random.default_rng(9)
    rows = [(g, float(rng.integers(0, 40)), int(rng.integers(0, 25)), i) for i in range(400) for g in ("a", "b", None)]
    df = A.xicor(spark.createDataFrame(rows, "grp string, x double, y long, pos long"))
    text = plan(df)
    assert "Window" not in text or "windowspecdefinition(grp" not in text
    got = {r.grp: (r.xi, r.z) for r in df.collect()}
    for grp in ("a", "b", None):
        own = sorted((x, p, y) for g, x, y, p in rows if g == grp)
        y = np.array([o[2] for o in own])
        r, l, n = (y[None] <= y[:, None]).sum(1), (y[None] >= y[:, None]).sum(1), len(y)
        xi = 1 - n * np.abs(np.diff(r)).sum() / (2 * (l * (n - l)).sum())
        u, i = np.sort(r).astype(float), np.arange(1, n + 1)
        v = np.cumsum(u)
        a, b, c = ((2 * (n - i) + 1) * u * u).sum() / n**4, ((v + (n - i) * u) ** 2).sum() / n**5, ((2 * (n - i) + 1) * u).sum() / n**3
        dev = np.sqrt((a - 2 * b + c * c) / ((l * (n - l)).sum() / n**3) ** 2 / n)
        assert abs(got[grp][0] - xi) < 1e-9 and abs(got[grp][1] - xi / dev) < 1e-7
