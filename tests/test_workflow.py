"""The workflow, lazy transforms, markers, imputation and further decompositions on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmat.functions.mitochondria import load_mito_features, mito_features
from sparkmat.operators import annotation as A
from sparkmat.operators import decomposition as D
from sparkmat.operators import graph as G
from sparkmat.operators import lazy as Z
from sparkmat.operators import matrix as M
from sparkmat.operators import network as N
from sparkmat.operators import plotdata as P
from sparkmat.operators.workflow import run_workflow

RNG = np.random.default_rng(11)


def coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "cell long, gene long, value double")


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cell long, vec array<double>")


def graph(spark, pairs):
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs if a != b]
    return spark.createDataFrame(rows, "src long, dst long, weight double")


@pytest.fixture(scope="module")
def m():
    return RNG.poisson(0.6, (40, 15)) * RNG.integers(1, 9, (40, 15)) + np.outer(np.arange(40) % 3 == 0, np.arange(15) < 5) * 6.0 + np.eye(40, 15)


@pytest.mark.parametrize("algorithm", ["irlb", "halko", "feng", "primme"])
def test_algorithms_agree(spark, m, algorithm):
    f = D.run_svd(coo(spark, m), 5, algorithm)
    assert np.allclose(f.d, np.linalg.svd(m)[1][:5], rtol=1e-6)


def test_user_operator(m):
    class Own:
        shape = m.shape

        def matvec(self, q):
            return m @ q

        def rmatvec(self, y):
            return m.T @ y

    u, d, v = D.run_svd_operator(Own(), 6)
    assert np.allclose(u * d @ v.T, (lambda t: (t[0][:, :6] * t[1][:6]) @ t[2][:6])(np.linalg.svd(m, full_matrices=False)), atol=1e-4)
    with pytest.raises(TypeError):
        D.run_svd_operator(object(), 2)


def test_empty_matrix(spark):
    f = D.run_svd(spark.createDataFrame([], "cell long, gene long, value double"), 3)
    assert len(f.d) == 0 and f.cells.count() == 0


def test_prior_correction_is_kept(spark, m):
    f = D.reduce_kernel(coo(spark, m), 15)
    z = np.eye(15)[:, [2]]
    more = D.perturbed_svd_with_prior(f, -z, D.multiply(f.cells, f.d[:, None] * (f.genes.T @ z)), f.a, f.b)
    assert more.a.shape == (15, 2) and all(len(r.vec) == 2 for r in more.b.collect())
    rows = {r.cell: np.array(r.vec) for r in more.reduction().collect()}
    want = m - m.mean(0)
    want[:, 2] = 0
    assert np.allclose(np.array([rows[i] for i in range(40)]) @ more.genes.T, want, atol=1e-6)
    plain = D.perturbed_svd_with_prior(f, -z, D.multiply(f.cells, f.d[:, None] * (f.genes.T @ z)))
    assert plain.a.shape == (15, 1)


def test_filter_share_and_masks(spark):
    x = spark.createDataFrame([(c, g, 1.0) for c in range(10) for g in range(4) if g < 2 or c == g], "cell long, gene long, value double")
    obs, var = spark.range(12).withColumnRenamed("id", "cell"), spark.range(5).withColumnRenamed("id", "gene")
    cells, genes = M.filter_axes(x, obs, var, min_cells=0.25, min_genes=1)
    assert {r.cell for r in cells.collect()} == set(range(10)) and {r.gene for r in genes.collect()} == {0, 1}
    assert {r.gene: r.keep for r in M.mask_table(var, genes, "gene").collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    with pytest.raises(IndexError):
        M.subset(x, [0, 12], 12)
    with pytest.raises(ValueError):
        M.subset(x, [], 12)
    assert {(r.cell, r.gene) for r in M.subset(x, [2, 2], 12).collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)}


def test_lazy_transform(spark, m):
    x = coo(spark, m)
    t = Z.create_lazy_transform(x, samples=4)
    assert len(t.key) == 24 and len(t.samples) == 4
    want = {(r.cell, r.gene): r.value for r in M.normalize(x).collect()}
    assert all(abs(r.value - want[r.cell, r.gene]) < 1e-9 for r in t.apply(x).collect())
    with pytest.raises(Z.StaleTransform):
        t.apply(x.where("cell > 0"))
    with pytest.raises(Z.StaleTransform):
        t.apply(x.withColumn("value", F.col("value") * 2))
    with pytest.raises(ValueError):
        Z.create_lazy_transform(x, pseudocount=0.5)
    assert Z.evenly_spaced(10, 4) == [0, 3, 6, 9] and Z.evenly_spaced(3, 16) == [0, 1, 2]


def test_markers_of_planted_groups(spark, m):
    x, groups = coo(spark, m), spark.createDataFrame([(i, "a" if i % 3 == 0 else "b") for i in range(40)], "cell long, grp string")
    table = A.find_markers(x, groups, 40, 15, top=5)
    assert {r.gene for r in table.where("grp = 'a'").collect()} == set(range(5))
    assert A.find_markers(x, groups, 40, 15, "ranks").count() == 30
    assert A.find_markers(x, groups, 40, 15, "scores", labels_use=["a"], keep=spark.range(3).withColumnRenamed("id", "gene")).count() == 3
    with pytest.raises(ValueError):
        A.find_markers(x, groups, 40, 15, "list")


def test_annotate_modes(spark):
    m = np.kron(np.eye(2), np.ones((10, 3))) * 5 + RNG.random((20, 6)) * 0.1
    ring = graph(spark, [(o + i, o + j) for o in (0, 10) for i in range(10) for j in range(i)])
    markers = spark.createDataFrame([("p", g, 1.0) for g in range(3)] + [("q", g, 1.0) for g in range(3, 6)], "label string, gene long, weight double")
    want = {i: "p" if i < 10 else "q" for i in range(20)}
    for method in ("vision", "network"):
        got = A.annotate(coo(spark, m), markers, ring, 6, method, propagate=True, log_p=True)
        assert {r.node: r.label for r in got["labels"].collect()} == want
        assert {r.node: r.label for r in got["labels_corrected"].collect()} == want
        assert got["log_pvals"].count() == got["enrichment"].count() == 40
    with pytest.raises(ValueError):
        A.annotate(coo(spark, m), markers, ring, 6, "other")
    with pytest.raises(ValueError):
        A.checked_markers(spark.createDataFrame([("p", "zz")], "label string, name string"), spark.createDataFrame([(0, "a")], "pos long, name string"))


def test_pca_imputation_without_diffusion_is_the_matrix(spark, m):
    x = coo(spark, m)
    ring = graph(spark, [(i, (i + 1) % 40) for i in range(40)])
    got = {(r.cell, r.gene): r.value for r in A.impute_pca(x, [0, 3], ring, D.reduce_kernel(x, 15), alpha=0.0).collect()}
    for g in (0, 3):
        assert np.allclose([got[i, g] for i in range(40)], m[:, g], atol=1e-5)


def test_permutations(spark):
    chain = graph(spark, [(i, i + 1) for i in range(60)])
    rising = spark.createDataFrame([(i, float(i)) for i in range(61)], "node long, value double")
    got = {r.statistic: r for r in G.permuted_autocorrelation(chain, rising, 12).collect()}
    assert got["moran"].z > 3 and got["geary"].z < -3 and abs(got["moran"].mu) < 0.2


def test_chebyshev(spark):
    pairs = [(i, (i + d) % 30) for i in range(30) for d in (1, 7)]
    a = np.zeros((30, 30))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    p = a / np.sqrt(np.outer(a.sum(0), a.sum(1)))
    x = RNG.random(30)
    got = {r.node: r.value for r in G.diffuse_chebyshev(graph(spark, pairs), spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node long, value double"), 0.5, 12).collect()}
    assert np.allclose([got[i] for i in range(30)], 0.5 * np.linalg.solve(np.eye(30) - 0.5 * p, x), atol=1e-5)


def test_xicor_matrix(spark):
    x = spark.createDataFrame([(i, "a", float(i)) for i in range(50)] + [(i, "b", float(i % 7)) for i in range(50)], "pos long, name string, value double")
    got = {(r.a, r.b): (r.xi, r.z) for r in A.xicor_matrix(x, x).collect()}
    assert got["a", "a"][0] > 0.9 and got["a", "a"][1] > 3 and len(got) == 4


def test_layouts(spark):
    pairs = [(o + i, o + j) for o in (0, 10) for i in range(10) for j in range(i)] + [(0, 10)]
    start = spark.createDataFrame([(i, float(i % 5), float(i % 3), float(i % 7)) for i in range(20)], "node long, x double, y double, z double")
    ones = start.selectExpr("node", "1.0D AS ai", "1.0D AS aj")
    for method in N.LAYOUTS:
        got = {r.node: np.array([r.x, r.y, r.z]) for r in N.layout(graph(spark, pairs), start, 3, method=method, factors=ones).collect()}
        assert len(got) == 20 and all(np.isfinite(v).all() for v in got.values())
    with pytest.raises(ValueError):
        N.layout(graph(spark, pairs), start, 3, method="leopold2")
    with pytest.raises(ValueError):
        N.layout(graph(spark, pairs), start, 3, method="spring")


def test_numbered(spark):
    t = spark.range(1000).withColumn("k", F.xxhash64("id") % 17).repartition(7)
    rows = N.numbered(t, "k", "id").collect()
    assert [r.slot for r in sorted(rows, key=lambda r: (r.k, r.id))] == list(range(1000))


def test_mitochondria(spark):
    assert load_mito_features(spark).count() == 74
    assert len(mito_features()) == 37 and len(mito_features(protein_coding=True)) == 13 and mito_features("ensembl_id", "mouse")[0] == "ENSMUSG00000064336"
    with pytest.raises(ValueError):
        mito_features("symbol")
    x = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 1, 2.0)], "cell long, gene long, value double")
    var = spark.createDataFrame([(0, "MT-ND1"), (1, "ACTB")], "gene long, name string")
    cells = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "cell long, grp string")
    assert {r.cell: r.value for r in P.mito_frame(x, cells, var, cells).collect()} == {0: 75.0, 1: 0.0, 2: 0.0}
    with pytest.raises(ValueError):
        P.mito_frame(x, cells, var.where("gene = 1"), cells)


def test_embedding_frame_kinds(spark):
    at = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "node long, x double, y double")
    color = lambda *v: spark.createDataFrame(list(enumerate(v)), "node long, value string")
    kinds = lambda df: {r.kind for r in df.collect()}
    assert kinds(P.embedding_frame(at)) == {"none"}
    assert kinds(P.embedding_frame(at, color("#111111", "#222222", None))) == {"rgb"}
    got = {r.node: r for r in P.embedding_frame(at, color("a", "#222222", None)).collect()}
    assert got[0].kind == "categorical" and got[2].missing and got[3].missing and not got[0].missing
    assert P.embedding_frame(at, sample=2).count() == 2
    shades = spark.range(3).select(P.gradient(F.col("id").cast("double"), F.lit(0.0), F.lit(2.0), [(0, 0, 0), (1, 0, 0), (1, 1, 1)]).alias("c")).collect()
    assert [r.c for r in shades] == ["#000000", "#ff0000", "#ffffff"]


def test_workflow(spark):
    corners = np.array([[4, 0, 0, 1], [0, 4, 0, 1], [0, 0, 4, 1.0]])
    cells = vectors(spark, np.vstack([RNG.dirichlet([8, 0.4, 0.4][i:] + [8, 0.4, 0.4][:i], 12) @ corners for i in range(3)]))
    out = run_workflow(cells, 2, 3, 5, k=6, algorithm="knn", epochs=4)
    assert {n: t.count() for n, t in out.items() if n != "network"} == dict.fromkeys(("H_stacked", "H_merged", "assigned_archetype", "archetype_footprint", "layout_2d", "layout_3d", "colors"), 36)
    assert all(0 <= v <= 1 for r in out["colors"].collect() for v in (r.r, r.g, r.b))
    default = run_workflow(cells, 2, 3, 5, epochs=2, three=False)
    assert "layout_3d" not in default and default["network"].count() > 0
