"""Decompositions of matrices (cell, gene, value): truncated SVD, kernel reduction, corrections, archetypes.

The cell side stays distributed as (cell, vec); the gene side, at most ``MAX_GENES`` by components, is a small dense
matrix of the driver. For an SVD the entries are gathered by cell once (``Blocks``); after that a product with X'X
is one pass without a shuffle of entries: each task multiplies its cells' block both ways and sends one gene side.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.operators.network import cut, drop

#: The gene side is held by the driver and sent to all tasks: 200,000 genes by 40 components are 64 MB.
MAX_GENES = 200_000
ALGORITHMS = ("auto", "irlb", "halko", "feng", "primme")
#: Up to this many genes X'X itself (32 MB) is gathered in one pass and decomposed exactly.
GRAM_GENES = 2048


@dataclass
class Factors:
    """X = cells diag(d) genes' (cells: (cell, vec), genes: len(names) x k), plus a correction A B' of the transpose."""

    genes: np.ndarray
    d: np.ndarray
    cells: DataFrame
    names: list[int]
    a: np.ndarray | None = None
    b: DataFrame | None = None

    def gene_table(self) -> DataFrame:
        rows = [(n, i, float(v)) for n, r in zip(self.names, self.genes) for i, v in enumerate(r)]
        return self.cells.sparkSession.createDataFrame(rows, "gene long, comp int, value double")

    def reduction(self) -> DataFrame:
        """(cell, vec): cells times diag(d)."""
        return scaled(self.cells, self.d)


def _array(values) -> list:
    return [F.lit(float(v)) for v in values]


def scaled(cells: DataFrame, by: np.ndarray) -> DataFrame:
    return cells.select("cell", F.zip_with("vec", F.array(*_array(by)), lambda x, y: x * y).alias("vec"))


def gene_names(x: DataFrame) -> list[int]:
    names = [r.gene for r in x.select("gene").distinct().limit(MAX_GENES + 1).collect()]
    if len(names) > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes")
    return sorted(names)


def times(x: DataFrame, names: list[int], r: np.ndarray) -> DataFrame:
    """X R as (cell, vec); R is len(names) x k."""
    side = x.sparkSession.createDataFrame(list(zip(names, r.astype(float).tolist())), "gene long, r array<double>")
    sums = [F.sum(F.col("value") * F.col("r")[i]).alias(f"v{i}") for i in range(r.shape[1])]
    return x.join(F.broadcast(side), "gene").groupBy("cell").agg(*sums).select("cell", F.array(*(f"v{i}" for i in range(r.shape[1]))).alias("vec"))


def transposed_times(x: DataFrame, names: list[int], y: DataFrame, k: int) -> np.ndarray:
    """X' Y for Y as (cell, vec): a len(names) x k matrix."""
    sums = [F.sum(F.col("value") * F.col("vec")[i]).alias(f"v{i}") for i in range(k)]
    t = x.join(y, "cell").groupBy("gene").agg(*sums).toPandas()
    out, at = np.zeros((len(names), k)), {g: i for i, g in enumerate(names)}
    out[[at[g] for g in t["gene"]]] = t[[f"v{i}" for i in range(k)]].to_numpy(float)
    return out


def multiply(cells: DataFrame, m: np.ndarray) -> DataFrame:
    """(cell, vec M)."""
    cols = [F.aggregate(F.zip_with("vec", F.array(*_array(m[:, j])), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) for j in range(m.shape[1])]
    return cells.select("cell", F.array(*cols).alias("vec"))


def _rows(column) -> np.ndarray:
    """A matrix of an Arrow column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gram(cells: DataFrame, k: int) -> np.ndarray:
    """Sum of vec' vec: a block product for each partition, then sums of its k * k entries."""

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column(0))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "v"])

    return _summed(cells.select("vec").mapInArrow(run, "at long, v double"), k * k).reshape(k, k)


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    """Sums of (at, v) by place; what the driver gets is ``n`` rows."""
    t = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n)
    out[t.column("at").to_numpy()] = t.column("v").to_numpy()
    return out


class Blocks:
    """A matrix gathered by cell: (cell, idx, val), written once, with genes numbered by ``names``."""

    def __init__(self, x: DataFrame):
        self.names, self.spark = gene_names(x), x.sparkSession
        at = self.spark.createDataFrame(list(zip(self.names, range(len(self.names)))), "gene long, at int")
        entry = F.struct("at", F.col("value").cast("double").alias("value"))
        rows = x.join(F.broadcast(at), "gene").groupBy("cell").agg(F.collect_list(entry).alias("e"))
        self.rows = cut(rows.select("cell", F.col("e.at").alias("idx"), F.col("e.value").alias("val")))

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows.count(), len(self.names)

    @staticmethod
    def _entries(batch: pa.RecordBatch, idx: int, val: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row of each entry, gene, value) of pieces of about 65,536 entries."""
        size = batch.column(idx).value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 16), "right")))
            i, v = (batch.column(c).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False) for c in (idx, val))
            yield lo, hi, np.repeat(np.arange(hi - lo), size[lo:hi]), i, v
            lo = hi

    @staticmethod
    def _product(n: int, row: np.ndarray, i: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((n, q.shape[1]))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        if len(first):
            out[row[first]] = np.add.reduceat(v[:, None] * q[i], first, axis=0)
        return out

    def times(self, q: np.ndarray) -> DataFrame:
        """X Q as (cell, vec)."""
        shared, k = self.spark.sparkContext.broadcast(q), q.shape[1]

        def run(batches):
            q = shared.value
            for batch in batches:
                for lo, hi, row, i, v in Blocks._entries(batch, 1, 2):
                    y = Blocks._product(hi - lo, row, i, v, q)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * k), pa.array(y.ravel()))], ["cell", "vec"])

        return self.rows.mapInArrow(run, "cell long, vec array<double>")

    def gram_times(self, q: np.ndarray) -> np.ndarray:
        """X'X Q: one pass."""
        shared, m, k = self.spark.sparkContext.broadcast(q), len(self.names), q.shape[1]

        def run(batches):
            q, total = shared.value, np.zeros((m, k))
            for batch in batches:
                for lo, hi, row, i, v in Blocks._entries(batch, 0, 1):
                    y = Blocks._product(hi - lo, row, i, v, q)
                    order = np.argsort(i, kind="stable")
                    g = i[order]
                    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
                    if len(first):
                        total[g[first]] += np.add.reduceat(v[order, None] * y[row[order]], first, axis=0)
            at = np.flatnonzero(total.any(1))
            places = (at[:, None] * k + np.arange(k)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[at].ravel())], ["at", "v"])

        return _summed(self.rows.select("idx", "val").mapInArrow(run, "at long, v double"), m * k).reshape(m, k)

    def gram(self) -> np.ndarray:
        """X'X: one pass of dense block products."""
        m = len(self.names)

        def run(batches):
            total = np.zeros((m, m))
            for batch in batches:
                for lo, hi, row, i, v in Blocks._entries(batch, 0, 1):
                    for a in range(0, hi - lo, 512):
                        mine = (row >= a) & (row < a + 512)
                        dense = np.zeros((min(512, hi - lo - a), m))
                        dense[row[mine] - a, i[mine]] = v[mine]
                        total += dense.T @ dense
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "v"])

        return _summed(self.rows.select("idx", "val").mapInArrow(run, "at long, v double"), m * m).reshape(m, m)


def signs(v: np.ndarray) -> np.ndarray:
    """+-1 by component, so that each column's largest entry is positive."""
    return np.where(v[np.argmax(np.abs(v), 0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else np.ones(v.shape[1])


def choose_algorithm(algorithm: str, n_genes: int) -> str:
    """auto: the exact X'X while it is small (``GRAM_GENES``), else halko."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if algorithm == "auto":
        return "gram" if n_genes <= GRAM_GENES else "halko"
    return algorithm


def _lanczos(times, m: int, k: int, extra: int, rng, tolerance: float) -> np.ndarray:
    """A basis from Lanczos steps on X'X with full orthogonalisation, until the k leading values settle."""
    q, basis, images, last = rng.normal(size=m), [], [], None
    for step in range(min(m, 4 * k + extra + 20)):
        for _ in range(2):
            for b in basis:
                q = q - (b @ q) * b
        norm = np.linalg.norm(q)
        if norm < 1e-12:
            break
        basis.append(q / norm)
        images.append(times(basis[-1][:, None])[:, 0])
        q = images[-1]
        if step >= k and step % 5 == 0:
            now = np.linalg.eigvalsh(np.array(basis) @ np.array(images).T)[::-1][:k]
            if last is not None and len(last) == len(now) and np.abs(now - last).max() <= tolerance * max(now[0], 1e-300):
                break
            last = now
    return np.array(basis).T


def _subspace(times, m: int, width: int, k: int, rng, rounds: int, tolerance: float) -> np.ndarray:
    """A basis from subspace iteration on X'X, until the k leading values settle or ``rounds`` are done."""
    q, last = np.linalg.qr(rng.normal(size=(m, width)))[0], None
    for _ in range(rounds):
        z = times(q)
        now = np.linalg.eigvalsh(q.T @ z)[::-1][:k]
        q = np.linalg.qr(z)[0]
        if last is not None and np.abs(now - last).max(initial=0) <= tolerance * max(now.max(initial=0), 1e-300):
            break
        last = now
    return q


def run_svd(x: DataFrame, k: int = 30, algorithm: str = "auto", rounds: int = 30, seed: int = 0, extra: int = 10, tolerance: float = 1e-9) -> Factors:
    """Truncated SVD; d falls, k is cut to the rank found, the largest entry of each gene vector is positive.

    irlb and primme are Lanczos steps (one vector a pass), halko and feng a subspace with ``extra`` further columns
    (fewer, wider passes; halko doubles the columns), each until the leading values settle to ``tolerance``;
    auto is exact for few genes (``choose_algorithm``).
    """
    choose_algorithm(algorithm, 0)
    blocks = Blocks(x)
    names, m = blocks.names, len(blocks.names)
    kind, rng = choose_algorithm(algorithm, m), np.random.default_rng(seed)
    if not m:
        return Factors(np.zeros((0, 0)), np.zeros(0), cut(blocks.times(np.zeros((0, 0)))), names)
    if kind == "gram":
        w, v = np.linalg.eigh(blocks.gram())
    else:
        if kind in ("irlb", "primme"):
            q = _lanczos(blocks.gram_times, m, min(k, m), extra, rng, tolerance)
        else:
            q = _subspace(blocks.gram_times, m, min((2 if kind == "halko" else 1) * k + extra, m), min(k, m), rng, rounds, tolerance)
        w, e = np.linalg.eigh((lambda z: (z + z.T) / 2)(q.T @ blocks.gram_times(q)))
        v = q @ e
    order = [i for i in np.argsort(-w)[:k] if w[i] > max(w.max(), 0) * 1e-14]
    d, v = np.sqrt(w[order]), v[:, order]
    v = v * signs(v)
    cells = cut(blocks.times(v / d))
    drop(blocks.rows)
    return Factors(v, d, cells, names)


def run_svd_operator(operator, k: int = 30, rounds: int = 30, seed: int = 0, extra: int = 10, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, d, v) of a user's operator with shape (cells, genes), matvec (X q) and rmatvec (X' y) of single vectors."""
    for name in ("shape", "matvec", "rmatvec"):
        if not hasattr(operator, name):
            raise TypeError(f"an operator needs {name}")
    n, m = operator.shape
    forward = lambda q: np.stack([np.asarray(operator.matvec(c), float) for c in q.T], 1)
    back = lambda y: np.stack([np.asarray(operator.rmatvec(c), float) for c in y.T], 1)
    q = _subspace(lambda z: back(forward(z)), m, min(k + extra, m, n), min(k, m, n), np.random.default_rng(seed), rounds, tolerance)
    u, d, wt = np.linalg.svd(forward(q), full_matrices=False)
    keep = [i for i in range(min(k, len(d))) if d[i] > d[0] * 1e-14]
    v = q @ wt[keep].T
    flip = signs(v)
    return u[:, keep] * flip, d[keep], v * flip


def perturbed_svd(f: Factors, a: np.ndarray, b: DataFrame) -> Factors:
    """SVD of genes diag(d) cells' + A B' (A: genes x c, B: (cell, vec)), by the QR update of both sides."""
    k, c = len(f.d), a.shape[1]
    both = f.cells.join(b.withColumnRenamed("vec", "more"), "cell", "full")
    zero = lambda n: F.array(*_array([0.0] * n))
    both = cut(both.select("cell", F.concat(F.coalesce("vec", zero(k)), F.coalesce("more", zero(c))).alias("vec")))
    left = np.linalg.qr(np.hstack([f.genes, a]))
    w, e = np.linalg.eigh(gram(both, k + c))
    keep = w > w.max() * 1e-12
    root = e[:, keep] * np.sqrt(w[keep])
    mid = np.zeros((k + c, k + c))
    mid[:k, :k], mid[k:, k:] = np.diag(f.d), np.eye(c)
    u, d, vt = np.linalg.svd(left[1] @ mid @ root, full_matrices=False)
    r = min(k, int((d > d[0] * 1e-12).sum())) if len(d) else 0
    genes = left[0] @ u[:, :r]
    flip = signs(genes)
    return Factors(genes * flip, d[:r], cut(multiply(both, (e[:, keep] / np.sqrt(w[keep])) @ vt[:r].T * flip)), f.names, a, b)


def perturbed_svd_with_prior(f: Factors, a: np.ndarray, b: DataFrame, old_a: np.ndarray | None = None, old_b: DataFrame | None = None) -> Factors:
    """``perturbed_svd`` of a factorisation that holds an earlier A B' already; the result keeps both side by side."""
    out = perturbed_svd(f, a, b)
    if old_a is None or not old_a.size:
        return out
    both = old_b.join(b.withColumnRenamed("vec", "more"), "cell", "full")
    zero = lambda n: F.array(*_array([0.0] * n))
    out.a = np.hstack([old_a, a])
    out.b = cut(both.select("cell", F.concat(F.coalesce("vec", zero(old_a.shape[1])), F.coalesce("more", zero(a.shape[1]))).alias("vec")))
    return out


def reduce_kernel(x: DataFrame, k: int = 30, n_cells: int | None = None, **svd) -> Factors:
    """SVD of the matrix with its mean profile taken off every cell; ``reduction()`` is the reduced matrix."""
    return reduce_from_svd(x, run_svd(x, k, **svd), n_cells)


def reduce_from_svd(x: DataFrame, f: Factors, n_cells: int | None = None) -> Factors:
    cells = x.select("cell").distinct()
    n = n_cells or cells.count()
    mean = {r.gene: r.s / n for r in x.groupBy("gene").agg(F.sum("value").alias("s")).collect()}
    a = -np.array([[mean[g]] for g in f.names])
    return perturbed_svd(f, a, cells.select("cell", F.array(F.lit(1.0)).alias("vec")))


def correct_batch(x: DataFrame, f: Factors, batches: DataFrame) -> Factors:
    """Takes the span of the batches' profiles, X' D for (cell, batch), out of a reduction; at least two batches."""
    names = sorted(r.batch for r in batches.select("batch").distinct().collect())
    if len(names) < 2:
        raise ValueError("at least two batches are needed")
    design = batches.select("cell", F.array(*((F.col("batch") == b).cast("double") for b in names)).alias("vec"))
    return _project_out(x, f, transposed_times(x, f.names, design, len(names)))


def correct_basal(x: DataFrame, f: Factors, genes: list[int]) -> Factors:
    """Takes the indicator of the basal genes out of a reduction."""
    found = np.isin(f.names, genes)
    if not found.any():
        raise ValueError("none of the genes is in the matrix")
    return _project_out(x, f, found[:, None].astype(float))


def _project_out(x: DataFrame, f: Factors, profile: np.ndarray) -> Factors:
    u, s, _ = np.linalg.svd(profile, full_matrices=False)
    z = u[:, s > s[0] * 1e-10]
    # (I - ZZ') genes d cells' = genes d cells' - Z (cells d genes' Z)'
    return perturbed_svd(f, -z, multiply(f.cells, f.d[:, None] * (f.genes.T @ z)))


def smooth_kernel(f: Factors, g: DataFrame, alpha: float = 0.85, rounds: int = 5, code: int = 0) -> DataFrame:
    """(cell, vec): the cells' factors without the correction, diffused over the graph, times d."""
    return smoothed(f, g, alpha, rounds, code)[1]


def smoothed(f: Factors, g: DataFrame, alpha: float = 0.85, rounds: int = 5, code: int = 0) -> tuple[Factors, DataFrame]:
    """The factors without the correction, and their smoothed cells times d."""
    from sparkmat.operators.annotation import diffuse_columns

    base = perturbed_svd(f, -f.a, f.b) if f.a is not None else f
    long = base.cells.select(F.col("cell").alias("node"), F.posexplode("vec").alias("label", "value"))
    x = diffuse_columns(g, long, alpha, rounds, code)
    cols = [F.coalesce(F.sum(F.when(F.col("label") == i, F.col("value"))), F.lit(0.0)) for i in range(len(base.d))]
    return base, scaled(x.groupBy(F.col("node").alias("cell")).agg(F.array(*cols).alias("vec")), base.d)


def _map(cells: DataFrame, kernel) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = np.ascontiguousarray(kernel(_rows(batch.column(1))), float)
                at = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], ["cell", "vec"])

    return cells.select("cell", "vec").mapInArrow(run, "cell long, vec array<double>")


def run_spa(cells: DataFrame, k: int) -> list[tuple[int, float]]:
    """Successive projections: k times the cell of largest norm (ties: smaller id) and that norm, which is then projected out."""
    basis, found = None, []
    for _ in range(k):
        left = cells if basis is None else _map(cells, lambda v, q=basis: v - (v @ q) @ q.T)
        norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
        r = left.select(F.struct((-F.round(norm, 12)).alias("n"), F.col("cell"), F.col("vec")).alias("s")).agg(F.min("s").alias("s")).first().s
        if r is None or r.n >= -1e-12:
            break
        v = np.array(r.vec)
        found.append((r.cell, float(np.linalg.norm(v))))
        q = (v / np.linalg.norm(v))[:, None]
        basis = q if basis is None else np.linalg.qr(np.hstack([basis, q]))[0]
    return found


def simplex_weights(points: np.ndarray, w: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights h >= 0 with sum 1 by row that bring h W nearest to each point, by accelerated projected gradients."""
    g, b = w @ w.T, points @ w.T
    step = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    h = np.full(b.shape, 1 / len(w))
    y, t = h, 1.0
    for _ in range(rounds):
        z = y - step * (y @ g - b)
        s = -np.sort(-z, axis=1)
        c = (np.cumsum(s, 1) - 1) / np.arange(1, z.shape[1] + 1)
        last = (s > c).sum(1) - 1
        new = np.maximum(z - c[np.arange(len(z)), last][:, None], 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, moved = new + (t - 1) / t2 * (new - h), np.abs(new - h).max(initial=0)
        h, t = new, t2
        if moved < 1e-12:
            break
    return h


def simplex_regression(cells: DataFrame, w: np.ndarray) -> DataFrame:
    """(cell, vec) of simplex weights on the rows of W."""
    return _map(cells, lambda v: simplex_weights(v, w))


def archetypal_analysis(cells: DataFrame, w: np.ndarray, rounds: int = 20, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Memberships H (cell, vec), archetypes W (k x d) and their cells C (comp, cell, weight).

    W starts at cells of the table. A round fits H by simplex regression, then steps each archetype toward the cell
    that lowers the loss most (Frank-Wolfe on C, one aggregation, exact step), so archetypes stay in the hull.
    """
    w, k, last = np.array(w, float), len(w), None
    steps: list[tuple[np.ndarray, list]] = []
    for _ in range(rounds):
        both = cut(simplex_regression(cells, w).withColumnRenamed("vec", "h").join(cells, "cell").select("cell", F.concat("h", "vec").alias("vec")))
        m = gram(both, k + w.shape[1])
        hh, hx = m[:k, :k], m[:k, k:]
        loss = float(np.trace(m[k:, k:]) - 2 * (hx * w).sum() + (hh * (w @ w.T)).sum())
        if last is not None and last - loss <= tolerance * max(last, 1e-12):
            break
        last, grad = loss, hh @ w - hx
        dots = multiply(cells, grad.T).withColumnRenamed("vec", "dot").join(cells, "cell")
        toward = dots.agg(*(F.min(F.struct(F.col("dot")[i].alias("d"), "cell", "vec")).alias(f"m{i}") for i in range(k))).first()
        path = np.array([t.vec for t in toward]) - w
        moved = np.zeros_like(w)
        sizes = np.zeros(k)
        for i in range(k):
            slope, curve = (grad[i] + hh[i] @ moved) @ path[i], hh[i, i] * (path[i] @ path[i])
            sizes[i] = min(1.0, max(0.0, -slope / curve)) if curve > 0 else 0.0
            moved[i] = sizes[i] * path[i]
        w = w + moved
        steps.append((sizes, [t.cell for t in toward]))
    weights: dict[tuple[int, int], float] = {}
    for sizes, to in steps:
        weights = {key: v * (1 - sizes[key[0]]) for key, v in weights.items()}
        for i, c in enumerate(to):
            weights[i, c] = weights.get((i, c), 0.0) + sizes[i]
    spark = cells.sparkSession
    c = spark.createDataFrame([(i, n, float(v)) for (i, n), v in sorted(weights.items()) if v > 0], "comp int, cell long, weight double")
    return simplex_regression(cells, w), w, c


@dataclass
class Action:
    """stacked (cell, k, comp, weight), its C (k, comp, cell, weight), archetypes by k; merged (cell, vec), its archetypes W and C."""

    stacked: DataFrame
    stacked_c: DataFrame
    archetypes: dict[int, np.ndarray]
    merged: DataFrame | None = None
    merged_w: np.ndarray | None = None
    merged_c: DataFrame | None = None

    def assigned(self) -> DataFrame:
        """(cell, vec, assigned): the first largest membership."""
        return self.merged.withColumn("assigned", F.array_position("vec", F.array_max("vec")).cast("int") - 1)

    def stacked_vectors(self) -> DataFrame:
        """(cell, vec): memberships of all k side by side."""
        order = F.array_sort(F.collect_list(F.struct("k", "comp", "weight")))
        return self.stacked.groupBy("cell").agg(F.transform(order, lambda t: t["weight"]).alias("vec"))


def fit_action(cells: DataFrame, k_min: int = 2, k_max: int = 30, rounds: int = 20, at_once: int = 4) -> Action:
    """Archetypes for every number from ``k_min`` to ``k_max``; the fits are independent, ``at_once`` of them run side by side."""
    spark = cells.sparkSession
    first = run_spa(cells, k_max)
    at = {r.cell: np.array(r.vec) for r in cells.where(F.col("cell").isin([c for c, _ in first])).collect()}

    def fit(k: int):
        h, w, c = archetypal_analysis(cells, np.array([at[c] for c, _ in first[:k]]), rounds)
        return k, h.select("cell", F.lit(k).alias("k"), F.posexplode("vec").alias("comp", "weight")), w, c.select(F.lit(k).alias("k"), "comp", "cell", "weight")

    with ThreadPoolExecutor(at_once) as pool:
        fits = list(pool.map(fit, range(k_min, min(k_max, len(first)) + 1)))
    h, c = spark.createDataFrame([], "cell long, k int, comp int, weight double"), spark.createDataFrame([], "k int, comp int, cell long, weight double")
    for _, more, _, cells_of in fits:
        h, c = h.unionByName(more), c.unionByName(cells_of)
    return Action(h, c, {k: w for k, _, w, _ in fits})


def decompose_action(cells: DataFrame, k_min: int = 2, k_max: int = 30, rounds: int = 20) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Memberships for every number of archetypes, stacked as (cell, k, comp, weight), and the archetypes by k."""
    found = fit_action(cells, k_min, k_max, rounds)
    return found.stacked, found.archetypes


def collect_archetypes(h: DataFrame, threshold: float = -3.0, min_observations: int = 3) -> DataFrame:
    """(k, comp) that are some cells' largest membership often enough and whose log mass is not far under the others'."""
    best = h.groupBy("cell", "k").agg(F.min(F.struct((-F.round("weight", 9)).alias("w"), "comp")).alias("b"))
    used = best.groupBy("k", F.col("b.comp").alias("comp")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_observations)
    mass = h.groupBy("k", "comp").agg(F.log(F.sum("weight") + 1e-12).alias("m"))
    stats = mass.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("m") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return mass.crossJoin(F.broadcast(stats)).where(z >= threshold).join(used, ["k", "comp"]).select("k", "comp")


def _merged(archetypes: dict[int, np.ndarray], kept: DataFrame, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    rows: list[np.ndarray] = []
    names: list[tuple[int, int]] = []
    for r in kept.orderBy("k", "comp").collect():
        v = archetypes[r.k][r.comp]
        if all(v @ w < cosine * np.linalg.norm(v) * np.linalg.norm(w) for w in rows):
            rows.append(v)
            names.append((r.k, r.comp))
    return np.array(rows), names


def merge_archetypes(cells: DataFrame, archetypes: dict[int, np.ndarray], kept: DataFrame, cosine: float = 0.98) -> tuple[DataFrame, np.ndarray]:
    """Memberships (cell, vec) of the representatives: kept archetypes, but not one within ``cosine`` of an earlier one."""
    w, _ = _merged(archetypes, kept, cosine)
    return simplex_regression(cells, w), w


def action(cells: DataFrame, k_min: int = 2, k_max: int = 30, rounds: int = 20, threshold: float = -3.0, min_observations: int = 2, prenormalize: bool = True) -> Action:
    """Archetypes of rows scaled to absolute sum 1 for every k, collected and merged."""
    x = cells
    if prenormalize:
        total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.abs(v))
        x = cells.withColumn("t", total).select("cell", F.transform("vec", lambda v: v / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)).alias("vec"))
    x = cut(x.select("cell", "vec"))
    found = fit_action(x, k_min, k_max, rounds)
    found.stacked = cut(found.stacked)
    w, names = _merged(found.archetypes, collect_archetypes(found.stacked, threshold, min_observations), 0.98)
    chosen = cells.sparkSession.createDataFrame([(k, c, i) for i, (k, c) in enumerate(names)], "k int, comp int, merged int")
    found.merged, found.merged_w = cut(simplex_regression(x, w)), w
    found.merged_c = found.stacked_c.join(F.broadcast(chosen), ["k", "comp"]).select(F.col("merged").alias("comp"), "cell", "weight")
    return found


def run_action(cells: DataFrame, k_min: int = 2, k_max: int = 30, rounds: int = 20, threshold: float = -3.0, min_observations: int = 2) -> DataFrame:
    """(cell, vec, assigned): merged memberships of rows scaled to absolute sum 1, and the first largest one."""
    return action(cells, k_min, k_max, rounds, threshold, min_observations).assigned()
