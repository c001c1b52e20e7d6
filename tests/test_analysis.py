"""Operators without SQL against numpy or brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmat.operators import annotation as A
from sparkmat.operators import decomposition as D
from sparkmat.operators import mixture as U
from sparkmat.operators import network as N
from sparkmat.operators import plotdata as P
from sparkmat.sources import dataset as S

RNG = np.random.default_rng(4)


def coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "cell long, gene long, value double")


def graph(spark, pairs):
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs if a != b]
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cell long, vec array<double>")


def dense(df, n):
    out = [None] * n
    for r in df.collect():
        out[r.cell] = r.vec
    return np.array(out)


@pytest.fixture(scope="module")
def m():
    return RNG.poisson(0.6, (40, 15)) * RNG.integers(1, 9, (40, 15)) + np.outer(np.arange(40) % 3 == 0, np.arange(15) < 5) * 6.0 + np.eye(40, 15)


def test_svd(spark, m):
    f = D.run_svd(coo(spark, m), 6)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(f.d, s[:6], rtol=1e-6)
    assert np.allclose(dense(f.reduction(), 40) @ f.genes.T, (u[:, :6] * s[:6]) @ vt[:6], atol=1e-3)
    assert (np.take_along_axis(f.genes, np.abs(f.genes).argmax(0)[None], 0) > 0).all()
    with pytest.raises(ValueError):
        D.run_svd(coo(spark, m), 2, "power")


def test_kernel_is_centred_and_corrections_project_out(spark, m):
    x = coo(spark, m)
    f = D.reduce_kernel(x, 15)
    centred = m - m.mean(0)
    assert np.allclose(dense(f.reduction(), 40) @ f.genes.T, centred, atol=1e-6)
    back = D.perturbed_svd(f, -f.a, f.b)
    assert np.allclose(dense(back.reduction(), 40) @ back.genes.T, m, atol=1e-6)
    batches = spark.createDataFrame([(i, i % 3) for i in range(40)], "cell long, batch int")
    z = np.linalg.qr(m.T @ np.eye(3)[np.arange(40) % 3])[0]
    c = D.correct_batch(x, f, batches)
    assert np.allclose(dense(c.reduction(), 40) @ c.genes.T, centred - centred @ z @ z.T, atol=1e-6)
    b = D.correct_basal(x, f, [2])
    want = centred.copy()
    want[:, 2] = 0
    assert np.allclose(dense(b.reduction(), 40) @ b.genes.T, centred - np.outer(centred[:, 2], np.eye(15)[2]), atol=1e-6)
    with pytest.raises(ValueError):
        D.correct_basal(x, f, [99])
    with pytest.raises(ValueError):
        D.correct_batch(x, f, batches.withColumn("batch", F.lit(1)))


def test_smooth_kernel_without_diffusion(spark, m):
    f = D.reduce_kernel(coo(spark, m), 15)
    ring = graph(spark, [(i, (i + 1) % 40) for i in range(40)])
    back = D.perturbed_svd(f, -f.a, f.b)
    assert np.allclose(dense(D.smooth_kernel(f, ring, alpha=0.0), 40), dense(back.reduction(), 40), atol=1e-8)


def test_archetypes(spark):
    corners = np.array([[0, 0, 1], [0, 4, 1], [5, 0, 1.0]])
    h = RNG.dirichlet([0.6] * 3, 60)
    pts = np.vstack([corners, h @ corners])
    cells = vectors(spark, pts).cache()
    spa = [c for c, _ in D.run_spa(cells, 3)]
    assert len(set(spa)) == 3 and spa[0] == 2
    assert np.allclose(dense(D.simplex_regression(cells, corners), 63) @ corners, pts, atol=1e-5)
    got, w, c = D.archetypal_analysis(cells, pts[[10, 20, 30]], 25)
    fit = dense(got, 63) @ w
    assert ((fit - pts) ** 2).sum() < 0.05 * ((pts - pts.mean(0)) ** 2).sum()
    weights = np.zeros((3, 63))
    for r in c.collect():
        weights[r.comp, r.cell] = r.weight
    assert weights.min() >= 0
    merged = D.run_action(cells, 2, 3, 5)
    rows = merged.collect()
    assert len(rows) == 63 and all(abs(sum(r.vec) - 1) < 1e-6 and r.vec[r.assigned] == max(r.vec) for r in rows)


@pytest.mark.parametrize("metric", ["l2", "ip", "jsd"])
def test_neighbours(spark, metric):
    v = np.abs(RNG.normal(size=(120, 5)))
    got = N.neighbours(vectors(spark, v), 4, metric, lists=5, block=40).collect()
    u = v / {"l2": 1, "ip": np.linalg.norm(v, axis=1, keepdims=True), "jsd": v.sum(1, keepdims=True)}[metric]
    ent = lambda p: (p * np.log2(p)).sum(-1)
    d = {"l2": lambda: np.linalg.norm(u[:, None] - u, axis=2), "ip": lambda: 1 - u @ u.T, "jsd": lambda: np.sqrt(np.maximum(ent(u)[:, None] / 2 + ent(u) / 2 - ent((u[:, None] + u) / 2), 0))}[metric]()
    np.fill_diagonal(d, np.inf)
    assert {(r.src, r.dst) for r in got} == {(i, int(j)) for i in range(120) for j in np.argsort(d[i])[:4]}
    assert all(abs(r.distance - d[r.src, r.dst]) < 1e-6 for r in got)
    with pytest.raises(ValueError):
        N.neighbours(vectors(spark, [[1.0, float("nan")]]), 1)


def test_coreness(spark):
    pairs = {tuple(sorted(p)) for p in RNG.integers(0, 30, (90, 2)).tolist()} | {(40, 40)}
    near = {i: set() for p in pairs for i in p}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, k, left = {}, 0, {i: set(s) for i, s in near.items()}
    while left:
        low = [i for i, s in left.items() if len(s) <= k]
        if not low:
            k += 1
        for i in low:
            want[i] = k
            for j in left.pop(i):
                if j in left:
                    left[j].discard(i)
    assert {r.node: r.coreness for r in N.coreness(graph(spark, pairs)).collect()} == want


def test_clusters_follow_blocks(spark):
    blocks = [range(0, 8), range(8, 14), range(14, 21)]
    pairs = [(a, b) for s in blocks for a in s for b in s if a < b] + [(0, 8), (9, 15)]
    g = graph(spark, pairs).cache()
    labels = N.cluster(g).cache()
    assert {r.node: r.label for r in labels.collect()} == {i: min(s) for s in blocks for i in s}
    assert N.modularity(g, labels).first()[0] > 0.5
    start = labels.withColumn("label", F.when(F.col("node") == 3, 8).otherwise(F.col("label")))
    assert {r.node: r.label for r in N.propagate_labels(g, start, least=0.5).collect()} == {i: min(s) for s in blocks for i in s}
    assert {r.node: r.label for r in N.propagate_labels(g, start, least=0.5, fixed=[3]).collect()}[3] == 8
    pr = {r.node: r.value for r in N.local_pagerank(g, labels).collect()}
    assert len(pr) == 21 and max(pr.values()) == 1.0


def test_layout_pulls_blocks_together(spark):
    pairs = [(a, b) for s in (range(6), range(6, 12)) for a in s for b in s if a < b]
    start = spark.createDataFrame([(i, float(i * 5 % 12), float(i * 7 % 12)) for i in range(12)], "node long, x double, y double")
    p = {r.node: np.array([r.x, r.y]) for r in N.layout(graph(spark, pairs), start, 20).collect()}
    inner = np.mean([np.linalg.norm(p[a] - p[b]) for a in range(6) for b in range(6) if a != b])
    outer = np.mean([np.linalg.norm(p[a] - p[b]) for a in range(6) for b in range(6, 12)])
    assert len(p) == 12 and np.isfinite([*p.values()]).all() and inner < outer


def test_colors_are_in_range(spark):
    t = spark.createDataFrame([(i, *map(float, RNG.normal(size=3))) for i in range(20)], "node long, a double, b double, c double")
    rows = N.node_colors(t).select("r", "g", "b", P.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("h")).collect()
    assert all(0 <= v <= 1 for r in rows for v in (r.r, r.g, r.b)) and all(len(r.h) == 7 and r.h == "#" + "".join(f"{int(v * 255 + 0.5):02x}" for v in (r.r, r.g, r.b)) for r in rows)


def test_assignment():
    from itertools import permutations

    for n, k in ((4, 4), (3, 5), (5, 3)):
        w = RNG.normal(size=(n, k))
        s = max(n, k)
        full = np.zeros((s, s))
        full[:n, :k] = np.maximum(w, 0)
        best = max(sum(full[i, p[i]] for i in range(s)) for p in permutations(range(s)))
        assert abs(sum(w[i, j] for i, j in N.assignment(w)) - best) < 1e-9


def test_mixture(spark):
    v = np.concatenate([RNG.normal(1.2, 0.1, 1500), RNG.normal(2.5, 0.1, 500)])
    rows = [(i, 1, float(10**x - 1)) for i, x in enumerate(v)] + [(i, 2, 50.0) for i in range(9)] + [(i, 3, 50.0 + i) for i in range(2)] + [(0, 4, 1.0)]
    x = spark.createDataFrame(rows, "cell long, guide long, value double")
    fit = {r.guide: r for r in U.fit_guides(x).collect()}
    assert [fit[i].status for i in (1, 2, 3, 4)] == [U.OK, U.CONSTANT, U.TOO_FEW, U.TOO_FEW]
    assert np.allclose(fit[1].means, [1.2, 2.5], atol=0.02) and np.allclose(fit[1].weights, [0.75, 0.25], atol=0.02) and abs(fit[1].sigma - 0.1) < 0.01
    calls = U.call_guides(x).where("guide = 1").agg(F.sum("foreground")).first()[0]
    assert 485 <= calls <= 500
    given = spark.createDataFrame([(1, 100.0)], "guide long, threshold double")
    assert U.call_guides(x, background=given).where("background <> foreground").count() == 0
    assert U.call_guides(x).where("guide > 1 and foreground = 1").count() == 0
    with pytest.raises(ValueError):
        U.thresholds(U.fit_guides(x), "other")


def test_annotate_cells(spark):
    m = np.zeros((8, 6))
    m[:4, :3] = m[4:, 3:] = 5
    m[:, 0] += 1
    markers = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 3, 1.0), ("b", 4, 1.0)], "label string, gene long, weight double")
    g = graph(spark, [(a, b) for s in (range(4), range(4, 8)) for a in s for b in s if a < b])
    got = {r.node: r.label for r in A.annotate_cells(coo(spark, m), markers, g, 6).collect()}
    assert got == {i: "a" if i < 4 else "b" for i in range(8)}


def test_violin(spark):
    v = RNG.normal(size=300)
    t = spark.createDataFrame([("g", float(x)) for x in v] + [("one", 1.0), ("flat", 2.0), ("flat", 2.0)], "grp string, value double")
    got = P.violin(t).orderBy("at").collect()
    h = v.std(ddof=1) * 300**-0.2
    d = np.exp(-((np.linspace(v.min(), v.max(), 64)[:, None] - v) ** 2) / 2 / h / h).sum(1)
    assert len(got) == 64 and np.allclose([r.width for r in got], 0.4 * d / d.max(), atol=2e-3)


def test_groups_sampled_alike_at_any_partitioning(spark):
    t = spark.range(200).withColumn("g", F.col("id") % 3)
    a, b = ({r.id for r in P.sample_groups(x, "g", 10, "id").collect()} for x in (t, t.repartition(7)))
    assert a == b and len(a) == 30


def test_color_kind(spark):
    t = spark.range(60).select("id", F.col("id").cast("string").alias("s"), (F.col("id") % 5).alias("few"), F.col("id").cast("double").alias("d"))
    assert [P.color_kind(t, c) for c in ("id", "s", "few", "d")] == ["continuous", "categorical", "categorical", "continuous"]


def test_import_and_dataset(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 2 4\n2 1 2\n2 2 3\n3 2 4\n1 1 9\n")
    (tmp_path / "features.tsv").write_text("E1\tA\nE2\tB\nE1\tC\n")
    (tmp_path / "barcodes.tsv").write_text("b0\nb1\n")
    x, obs, var = S.import_matrix(spark, f"file://{tmp_path}", "m.mtx", "features.tsv", "barcodes.tsv", ["id", "Gene"], ["Barcode"])
    assert {tuple(r) for r in x.collect()} == {(0, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0), (0, 0, 9.0)}
    assert var.columns == ["gene", "id", "Gene_label", "name"]
    assert [r.name for r in var.orderBy("gene").collect()] == ["E1", "E2", "E1_1"]
    d = S.Dataset(spark, f"file://{tmp_path}/data")
    d.put(obs=obs, var=var, X=x, uns={"a": 1, "gone": None})
    d.auto_persist = False
    d.put(obsm__action=spark.createDataFrame([(0, 1.5)], "cell long, v double"))
    again = S.Dataset(spark, f"file://{tmp_path}/data")
    assert again.names() == ["X", "obs", "var"] and again.index["uns"] == {"a": 1} and d.checkpoint() == ["obsm/action"]
    part = d.materialize(f"file://{tmp_path}/part", spark.createDataFrame([(1,)], "cell long"))
    assert part["X"].count() == 2 and part["obs"].count() == 1 and part["obsm/action"].count() == 0 and d["X"].count() == 4
    with pytest.raises(ValueError):
        d.materialize(f"file://{tmp_path}/none", spark.createDataFrame([(9,)], "cell long"))
    with pytest.raises(ValueError):
        d.put(obsm__bad=spark.createDataFrame([(0, float("nan"))], "cell long, v double"), validate=True)
    with pytest.raises(ValueError):
        S.import_matrix(spark, f"file://{tmp_path}", "m.mtx", "barcodes.tsv", "barcodes.tsv")
