"""Operators on long-form sparse matrices (cell, gene, value); explicit zeros are not stored, implicit ones count in means."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmat.operators.network import cut, drop


def filter_stats(x: DataFrame, obs: DataFrame, var: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, total, n_genes) and (gene, n_cells) of the whole axes, 0 where nothing is stored."""
    cells = x.groupBy("cell").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_genes"))
    genes = x.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return obs.select("cell").join(cells, "cell", "left").select("cell", zero("total"), zero("n_genes")), var.select("gene").join(genes, "gene", "left").select("gene", zero("n_cells"))


def filter_axes(x: DataFrame, obs: DataFrame, var: DataFrame, min_cells: float | None = None, min_genes: int | None = None, min_total: float | None = None, max_total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The (cell) and (gene) that stay when both are judged together on the same submatrix, again and again until nothing goes.

    ``min_cells`` in (0, 1) is a share of the cells that are left, rounded up; None and 0 judge nothing. A round writes
    only the cells and genes that stay, so plans stay short and the disk holds ``x`` once.
    """
    x, cells, genes = cut(x), cut(obs.select("cell")), cut(var.select("gene"))
    size = cells.count(), genes.count()
    while True:
        now = x.join(cells, "cell", "left_semi").join(genes, "gene", "left_semi")
        by_cell, by_gene = filter_stats(now, cells, genes)
        for value, judged in ((min_total, F.col("total") >= F.lit(min_total)), (max_total, F.col("total") <= F.lit(max_total)), (min_genes, F.col("n_genes") >= F.lit(min_genes))):
            by_cell = by_cell.where(judged) if value else by_cell
        if min_cells:
            by_gene = by_gene.where(F.col("n_cells") >= (math.ceil(min_cells * size[0]) if 0 < min_cells < 1 else min_cells))
        kept = cut(by_cell.select("cell")), cut(by_gene.select("gene"))
        drop(cells, genes)
        cells, genes = kept
        before, size = size, (cells.count(), genes.count())
        if size == before:
            return cells, genes


def mask_table(axis: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """``axis`` with ``keep``: whether the key is among ``kept``."""
    return axis.join(kept.select(key).withColumn("keep", F.lit(True)), key, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def filter_masks(x: DataFrame, min_cells: float = 0, min_genes: int = 0, min_total: float = 0, max_total: float | None = None) -> DataFrame:
    """``x`` on the axes that ``filter_axes`` keeps of those with entries."""
    cells, genes = filter_axes(x, x.select("cell").distinct(), x.select("gene").distinct(), min_cells, min_genes, min_total, max_total)
    return x.join(cells, "cell", "left_semi").join(genes, "gene", "left_semi")


def row_total(x: DataFrame, axis: str = "cell") -> Column:
    return F.sum("value").over(Window.partitionBy(axis))


def normalize(x: DataFrame, target: float = 1e4, log_base: float | None = None, pseudocount: float = 1.0) -> DataFrame:
    total = row_total(x)
    y = F.log(F.when(total > 0, F.col("value") * target / total).otherwise(0.0) + pseudocount)
    return x.withColumn("value", y if log_base is None else y / F.log(F.lit(log_base)))


def lp_normalize(x: DataFrame, p: float = 1, axis: str = "cell") -> DataFrame:
    norm = F.pow(F.sum(F.pow(F.abs("value"), F.lit(p))).over(Window.partitionBy(axis)), F.lit(1.0 / p))
    return x.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")))


def column_scores(x: DataFrame, n_cells: int, center: bool = True, scale: bool = True) -> DataFrame:
    """(gene, mean, sd): what ``standardize`` takes off and divides by (ddof 1, implicit zeros counted, deviation 0 -> 1)."""
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    sd = F.sqrt(F.greatest((q - s * s / n_cells) / max(n_cells - 1, 1), F.lit(0.0)))
    return x.groupBy("gene").agg((s / n_cells if center else F.lit(0.0)).alias("mean"), (F.when(sd > 0, sd).otherwise(1.0) if scale else F.lit(1.0)).alias("sd"))


#: Genes of a dense row: ``standardize`` holds their means and deviations in every task (16 bytes each).
MOST_GENES = 200_000


def standardize(x: DataFrame, cells: DataFrame, center: bool = True, scale: bool = True) -> DataFrame:
    """z-scores of every cell and every gene with entries, implicit zeros included: (cell, gene, value), dense.

    Only the stored entries are shuffled, to their cell; rows are filled where they are.
    """
    spark, n = x.sparkSession, cells.count()
    stats = column_scores(x, n, center, scale).orderBy("gene").limit(MOST_GENES + 1).toPandas()
    if len(stats) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    shared = spark.sparkContext.broadcast(tuple(stats[c].to_numpy() for c in ("gene", "mean", "sd")))

    def run(batches):
        genes, mean, sd = shared.value
        zero = -mean / sd
        for batch in batches:
            for i in range(0, batch.num_rows, max(1, (1 << 20) // max(len(genes), 1))):
                part = batch.slice(i, max(1, (1 << 20) // max(len(genes), 1)))
                entries = part.column(1)
                dense = np.tile(zero, (part.num_rows, 1))
                flat = entries.flatten()
                row = np.repeat(np.arange(part.num_rows), entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                at = np.searchsorted(genes, flat.field("gene").to_numpy(zero_copy_only=False))
                dense[row, at] = (flat.field("value").to_numpy(zero_copy_only=False) - mean[at]) / sd[at]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(genes)))), pa.array(np.tile(genes, part.num_rows)), pa.array(dense.ravel())], ["cell", "gene", "value"])

    rows = x.groupBy("cell").agg(F.collect_list(F.struct("gene", F.col("value").cast("double").alias("value"))).alias("entries"))
    every = cells.select(F.col("cell").cast("long").alias("cell")).join(rows, "cell", "left")
    return every.mapInArrow(run, "cell long, gene long, value double")


def matrix_sums(x: DataFrame, axis: str | None, every: DataFrame | None = None) -> DataFrame:
    """(axis, total, nnz) of cells or genes, or one row for axis None; ``every``, the axis' table, keeps those without entries."""
    total, nnz = F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz")
    if axis is None:
        return x.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"), nnz)
    found = x.groupBy(axis).agg(total, nnz)
    if every is None:
        return found
    return every.select(axis).join(found, axis, "left").select(axis, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def restricted_sums(x: DataFrame, axis: str, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """(axis, total, nnz, sum_sq) over the given cells and genes only; a listed member of the axis without entries has 0."""
    for keep, key in ((cells, "cell"), (genes, "gene")):
        x = x if keep is None else x.join(keep.select(key).distinct(), key, "left_semi")
    found = x.groupBy(axis).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"))
    listed = cells if axis == "cell" else genes
    if listed is None:
        return found
    return listed.select(axis).distinct().join(found, axis, "left").select(axis, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "nnz", "sum_sq")))


def global_min(x: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """One row: the least value, implicit zeros among them unless every entry is stored; none or not finite gives 0."""
    least = F.min("value").cast("double")
    full = F.count(F.lit(1)) >= n_cells * n_genes
    value = F.when(full, least).otherwise(F.least(least, F.lit(0.0)))
    return x.agg(value.alias("m")).select(F.when(F.col("m").isNotNull() & ~F.isnan("m") & (F.abs("m") != float("inf")), F.col("m")).otherwise(0.0).alias("global_min"))


def row_chunks(x: DataFrame, start: int, end: int, genes: DataFrame | None = None) -> DataFrame:
    """Cells in [start, end), of the given genes where any are given; the range reaches the scan."""
    x = x.where((F.col("cell") >= start) & (F.col("cell") < end))
    return x if genes is None else x.join(genes.select("gene").distinct(), "gene", "left_semi")


def subset(x: DataFrame, index: list[int], n: int, axis: str = "cell") -> DataFrame:
    """``take`` by positions 0 .. n - 1, order and repeats kept; an empty list or a position outside is an error."""
    if not index:
        raise ValueError("no position is given")
    if min(index) < 0 or max(index) >= n:
        raise IndexError(f"positions run from 0 to {n - 1}")
    rows = x.sparkSession.createDataFrame(list(enumerate(index)), f"pos long, {axis} long")
    return take(x, rows, axis)


def apply_rowwise(x: DataFrame, function, cells: DataFrame, n_genes: int, block: int = 4096) -> DataFrame:
    """A user's function(block, first cell, number of cells) on dense blocks of at most ``block`` cells; zeros are not stored again.

    Cells meet in blocks by id, so a block is the same whatever the partitioning.
    """

    def run(key, table):
        cells = np.unique(table.column("cell").to_numpy())
        dense = np.zeros((len(cells), n_genes))
        some = table.filter(table.column("gene").is_valid())
        dense[np.searchsorted(cells, some.column("cell").to_numpy()), some.column("gene").to_numpy()] = some.column("value").to_numpy()
        out = np.asarray(function(dense, int(cells[0]), len(cells)), float)
        i, j = np.nonzero(out)
        return pa.table({"cell": cells[i], "gene": j.astype(np.int64), "value": out[i, j]})

    every = cells.select("cell").join(x, "cell", "left").select("cell", "gene", F.col("value").cast("double").alias("value"))
    return every.groupBy(F.floor(F.col("cell") / block).alias("block")).applyInArrow(run, "cell long, gene long, value double")


def feature_abundance(x: DataFrame, features: DataFrame, cells: DataFrame, metric: str = "fraction", nonzero: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """(cell, metric[, grp]) of every cell: the sum (or the number over 0) of (gene) ``features``, a gene listed twice counting twice."""
    if metric not in ("counts", "fraction", "percent", "ratio"):
        raise ValueError(f"unknown metric {metric!r}")
    amount = F.when(F.col("value") > 0, 1.0).otherwise(0.0) if nonzero else F.col("value").cast("double")
    times = features.groupBy("gene").agg(F.count(F.lit(1)).alias("times"))
    sums = x.join(times, "gene", "left").groupBy("cell").agg(F.sum(amount * F.coalesce("times", F.lit(0))).alias("part"), F.sum(amount).alias("total"))
    part, total = F.coalesce("part", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    value = {"counts": part, "fraction": F.when(total > 0, part / total).otherwise(0.0), "percent": F.when(total > 0, 100 * part / total).otherwise(0.0), "ratio": F.when(total - part > 0, part / (total - part))}[metric]
    out = cells.select("cell").join(sums, "cell", "left").select("cell", value.alias(metric))
    return out if groups is None else out.join(groups, "cell")


def aggregate(x: DataFrame, groups: DataFrame) -> DataFrame:
    """sum, mean, var (ddof 1, a single cell gives 0) and non-zeros by (grp, gene); ``groups``: (cell, grp)."""
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    a = x.join(groups, "cell").groupBy("grp", "gene").agg(F.sum("value").alias("sum_value"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("nnz"))
    s, n = F.col("sum_value"), F.col("n")
    return a.join(size, "grp").select("grp", "gene", "sum_value", (s / n).alias("mean_value"), F.when(n > 1, (F.col("q") - s * s / n) / (n - 1)).otherwise(0.0).alias("var_value"), "nnz")


def abundance(x: DataFrame, genes: list[int], metric: str = "fraction") -> DataFrame:
    part = F.coalesce(F.sum(F.when(F.col("gene").isin(genes), F.col("value"))), F.lit(0.0))
    total = F.sum("value")
    value = {"counts": part, "fraction": F.when(total > 0, part / total).otherwise(0.0), "percent": F.when(total > 0, 100 * part / total).otherwise(0.0), "ratio": F.when(total - part > 0, part / (total - part))}[metric]
    return x.groupBy("cell").agg(value.alias(metric))


def row_moments(x: DataFrame, n_genes: int) -> DataFrame:
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return x.groupBy("cell").agg(q.alias("sum_sq"), (s / n_genes).alias("mu"), ((q - s * s / n_genes) / (n_genes - 1)).alias("sigma_sq"))


def dot(x: DataFrame, r: DataFrame) -> DataFrame:
    """X times R, R as (gene, comp, weight)."""
    return x.join(r, "gene").groupBy("cell", "comp").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def specificity(x: DataFrame, groups: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """Bernstein tail scores of each gene in each group against its expectation under the cells' detection rates."""
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    rate = x.groupBy("cell").agg((F.count(F.lit(1)) / n_genes).alias("q"))
    mean_rate = rate.agg((F.sum("q") / n_cells).alias("mq"))
    gamma = groups.join(size, "grp").join(rate, "cell").join(F.broadcast(mean_rate)).select("grp", (F.col("q") / F.col("mq") / F.col("n")).alias("g")).groupBy("grp").agg(F.sum("g").alias("g1"), F.sum(F.col("g") * F.col("g")).alias("g2"), F.max("g").alias("gm"))
    gene = x.groupBy("gene").agg((F.count(F.lit(1)) / n_cells).alias("p"), F.avg("value").alias("r"))
    obs = x.join(groups, "cell").join(size, "grp").groupBy("grp", "gene").agg((F.sum("value") / F.first("n")).alias("profile"))
    t = obs.join(gene, "gene").join(gamma, "grp")
    lam = F.col("profile") - F.col("p") * F.col("r") * F.col("g1")
    nu = F.col("p") * F.col("r") * F.col("r") * F.col("g2")
    up = F.when(lam > 0, lam * lam / (2 * (nu + lam * F.col("r") * F.col("gm") / 3)) / F.log(F.lit(10.0))).otherwise(0.0)
    low = F.when(lam < 0, lam * lam / (2 * nu) / F.log(F.lit(10.0))).otherwise(0.0)
    return t.select("grp", "gene", "profile", up.alias("upper"), low.alias("lower"))


def top_markers(scores: DataFrame, n: int) -> DataFrame:
    score = F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.round(score, 9).desc(), F.desc("gene")))
    return scores.select("grp", "gene", rank.alias("rank")).where(F.col("rank") <= n)


def max_ranks(scores: DataFrame) -> DataFrame:
    """Rank by descending value; ties take their largest rank."""
    return scores.withColumn("rank", F.count(F.lit(1)).over(Window.partitionBy("cell").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, 0)))


def relabel_by_size(labels: DataFrame, min_size: int) -> DataFrame:
    """Clusters under ``min_size`` become 0, others 1..K by descending size, ties by the old label."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rank = size.where(F.col("n") >= min_size).withColumn("new_label", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    return labels.join(rank.select("label", "new_label"), "label", "left").select("cell", F.coalesce("new_label", F.lit(0)).alias("new_label"))


def argmax(scores: DataFrame) -> DataFrame:
    """The first best column of each cell and its value."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("value"), "gene"))
    return scores.withColumn("r", rank).where("r = 1").select("cell", F.col("gene").alias("best"), F.col("value").alias("confidence"))


def first_match(requested: DataFrame, features: DataFrame) -> DataFrame:
    """Requested names with the first feature position of that name (null: missing); nulls never match."""
    first = features.where("name is not null").groupBy("name").agg(F.min("pos").alias("pos"))
    return requested.join(first, "name", "left")


def unique_names(names: DataFrame) -> DataFrame:
    """Repeats of a name get _1, _2, ... in order of position."""
    r = F.row_number().over(Window.partitionBy("name").orderBy("pos")) - 1
    return names.select("pos", F.when(r > 0, F.concat_ws("_", "name", r.cast("string"))).otherwise(F.col("name")).alias("unique_name"))


def aggregate_annotated(x: DataFrame, obs: DataFrame, by: list[str], min_count: int = 0) -> DataFrame:
    """``aggregate`` by the joined values of obs columns, groups under ``min_count`` cells left out, with each group's n_obs."""
    label = obs.select("cell", F.concat_ws("_", *(F.col(c).cast("string") for c in by)).alias("grp"))
    size = label.groupBy("grp").agg(F.count(F.lit(1)).alias("n_obs")).where(F.col("n_obs") >= min_count)
    return aggregate(x, label.join(size, "grp", "left_semi")).join(size, "grp")


def scale_by(x: DataFrame, factors: DataFrame, axis: str = "cell") -> DataFrame:
    """Values times the factor of their cell or gene (axis, factor); entries without one are 0 and go."""
    return x.join(factors, axis).select("cell", "gene", (F.col("value") * F.col("factor")).alias("value"))


def take(x: DataFrame, index: DataFrame, axis: str = "cell") -> DataFrame:
    """The rows (or columns) of (pos, axis) in that order: repeats stay, ids become positions."""
    other = "gene" if axis == "cell" else "cell"
    return x.join(index, axis).select(F.col("pos").alias(axis), other, "value").select("cell", "gene", "value")


def one_hot(groups: DataFrame) -> DataFrame:
    """(cell, comp, weight) indicators of (cell, grp): comp counts the sorted groups from 0; nulls have no entry."""
    names = groups.where("grp is not null").select("grp").distinct().withColumn("comp", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long"))
    return groups.join(names, "grp").select("cell", "comp", F.lit(1.0).alias("weight"))
