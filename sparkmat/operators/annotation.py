"""Annotation statistics: marker sets, cell and cluster enrichment, imputation, rank correlation.

Matrices are (cell, gene, value), markers (label, gene, weight), graphs (src, dst, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmat.operators import graph as G
from sparkmat.operators.matrix import dot, row_moments, specificity


def encode_markers(markers: DataFrame, features: DataFrame) -> DataFrame:
    """(label, name) against features (pos, name): one weight 1 for each label and matched feature.

    A repeated name means its first feature, a repeat within a label counts once, nulls and unknown names go.
    """
    first = features.where("name is not null").groupBy("name").agg(F.min("pos").alias("gene"))
    return markers.join(first, "name").select("label", "gene").distinct().withColumn("weight", F.lit(1.0))


def checked_markers(markers: DataFrame, features: DataFrame) -> DataFrame:
    """``encode_markers``; a marker without a label, or no match at all, is an error."""
    if markers.where("label is null").limit(1).count():
        raise ValueError("a marker has no label")
    found = encode_markers(markers, features)
    if not found.limit(1).count():
        raise ValueError("no marker is among the features")
    return found


def find_markers(x: DataFrame, labels: DataFrame, n_cells: int, n_genes: int, result: str = "table", top: int | None = 50, labels_use: list | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Genes specific to each group of (cell, grp), by max(upper - lower, 0) of ``matrix.specificity``; every gene with entries is scored.

    table: (grp, rank, gene), the ``top`` first (None: all), ties to the larger gene; ranks: (grp, gene, rank), ties
    their largest; scores: (grp, gene, score). Cells of other groups than ``labels_use`` weigh nothing but stay in
    the matrix; ``keep`` (gene) leaves other genes out of the result.
    """
    if result not in ("table", "ranks", "scores"):
        raise ValueError(f"unknown result {result!r}")
    used = labels.where("grp is not null")
    used = used if labels_use is None else used.where(F.col("grp").isin(labels_use))
    genes = x.select("gene").distinct()
    genes = genes if keep is None else genes.join(keep.select("gene").distinct(), "gene", "left_semi")
    # Groups are few names; the frame is the result's own size.
    frame = genes.crossJoin(used.select("grp").distinct())
    score = F.greatest(F.coalesce(F.col("upper") - F.col("lower"), F.lit(0.0)), F.lit(0.0))
    scored = frame.join(specificity(x, used, n_cells, n_genes), ["grp", "gene"], "left").select("grp", "gene", F.round(score, 9).alias("score"))
    if result == "scores":
        return scored
    if result == "ranks":
        w = Window.partitionBy("grp").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
        return scored.select("grp", "gene", F.count(F.lit(1)).over(w).alias("rank"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("gene")))
    table = scored.select("grp", rank.alias("rank"), "gene")
    return table if top is None else table.where(F.col("rank") <= top)


def vision_stats(x: DataFrame, markers: DataFrame, n_genes: int) -> DataFrame:
    """z of each cell's marker sum against the cell's mean and variance over all genes; every stored cell and label."""
    sizes = markers.groupBy("label").agg(F.sum("weight").alias("m1"), F.sum(F.col("weight") * F.col("weight")).alias("m2"))
    sums = dot(x, markers.withColumnRenamed("label", "comp")).withColumnRenamed("comp", "label").withColumnRenamed("value", "s")
    # The marker sets are a handful of names given by the caller: the product with the cells is the result's own size.
    every = row_moments(x, n_genes).crossJoin(F.broadcast(sizes)).join(sums, ["cell", "label"], "left")
    z = (F.coalesce("s", F.lit(0.0)) - F.col("mu") * F.col("m1")) / F.sqrt(F.col("sigma_sq") * F.col("m2"))
    return every.select("cell", "label", F.when(F.col("sigma_sq") > 0, z).otherwise(0.0).alias("value"))


def best_label(scores: DataFrame, key: str = "cell") -> DataFrame:
    """The first best label of each key, and its value."""
    best = scores.groupBy(key).agg(F.min(F.struct((-F.col("value")).alias("v"), "label")).alias("b"))
    return best.select(key, F.col("b.label").alias("label"), (-F.col("b.v")).alias("confidence"))


def marker_stats(x: DataFrame, markers: DataFrame, g: DataFrame, n_genes: int, method: str = "vision", alpha: float = 0.85, rounds: int = 5, code: int = 0, ignore_baseline: bool = False) -> DataFrame:
    """(node, label, value): vision: z-scores of the marker sums, smoothed over the graph; network: the markers' columns
    smoothed, summed by label and, unless ``ignore_baseline``, less the label's mean over the graph's nodes. Not finite is 0.
    """
    from sparkmat.operators.network import cut

    if method == "vision":
        smooth = diffuse_columns(g, vision_stats(x, markers, n_genes).withColumnRenamed("cell", "node"), alpha, rounds, code)
    elif method == "network":
        # Smoothing is linear: the markers' columns are summed by label before it, and one column a label is smoothed.
        columns = x.join(markers, "gene").groupBy(F.col("cell").alias("node"), "label").agg(F.sum(F.col("value").cast("double") * F.col("weight")).alias("value"))
        smooth = diffuse_columns(g, columns, alpha, rounds, code)
        if not ignore_baseline:
            every = g.select(F.col("src").alias("node")).union(x.select("cell")).distinct()
            frame = every.crossJoin(markers.select("label").distinct())
            full = cut(frame.join(smooth, ["node", "label"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))))
            mean = full.groupBy("label").agg(F.avg("value").alias("mean"))
            smooth = full.join(F.broadcast(mean), "label").select("node", "label", (F.col("value") - F.col("mean")).alias("value"))
    else:
        raise ValueError(f"unknown method {method!r}")
    value = F.col("value")
    return smooth.select("node", "label", F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value).otherwise(0.0).alias("value"))


def graph_log_p(g: DataFrame, stats: DataFrame) -> DataFrame:
    """(node, label, value): enrichment of the stats' positive parts among each node's neighbours, rows of the graph summing to 1."""
    n = stats.select("node").distinct().count()
    up = stats.withColumn("value", F.greatest("value", F.lit(0.0)))
    return G.label_enrichment(G.normalize_graph(g, 1), up, n).select(F.col("src").alias("node"), "label", F.col("score").alias("value"))


def annotate(x: DataFrame, markers: DataFrame, g: DataFrame, n_genes: int, method: str = "vision", alpha: float = 0.85, rounds: int = 5, code: int = 0, ignore_baseline: bool = False, enrich: bool = True, propagate: bool = False, log_p: bool = False) -> dict[str, DataFrame]:
    """labels (node, label, confidence) and enrichment (node, label, value); log_pvals and labels_corrected (node, label) on request."""
    from sparkmat.operators.network import cut, propagate_labels

    if not markers.limit(1).count():
        raise ValueError("there is no marker")
    x, g = cut(x), cut(g)  # read by the statistic, its baseline and the enrichment
    stats = cut(marker_stats(x, markers, g, n_genes, method, alpha, rounds, code, ignore_baseline))
    scores = graph_log_p(g, stats) if enrich or log_p else None
    labels = best_label(scores if enrich else stats, "node")
    out = {"labels": labels, "enrichment": stats}
    if log_p:
        out["log_pvals"] = scores
    if propagate:
        out["labels_corrected"] = propagate_labels(g, labels.select("node", "label"))
    return out


def annotate_cells(x: DataFrame, markers: DataFrame, g: DataFrame, n_genes: int, alpha: float = 0.85, rounds: int = 5, enrich: bool = True) -> DataFrame:
    """The labels of ``annotate`` by the vision statistic."""
    return annotate(x, markers, g, n_genes, alpha=alpha, rounds=rounds, enrich=enrich)["labels"]


def diffuse_columns(g: DataFrame, scores: DataFrame, alpha: float = 0.85, rounds: int = 5, code: int = 0) -> DataFrame:
    """x <- alpha P x + (1 - alpha) x0 for each label of (node, label, value); missing entries are 0, alpha 0 gives the scores."""
    from sparkmat.operators.network import cut, dealt

    if not alpha or not rounds:
        return scores
    p, start = dealt(G.normalize_graph(g, code), "dst"), cut(scores.select("node", "label", "value"))
    found = G.side_by_side(start)
    if found and found[1]:
        return G.one_by_one(_diffused(p, cut(found[0]), len(found[1]), alpha, rounds), found[1], scores.schema["label"].dataType)
    x, start = start, start.withColumnRenamed("value", "x0")
    for _ in range(rounds):
        moved = p.join(x, p["dst"] == x["node"]).groupBy(F.col("src").alias("node"), "label").agg(F.sum(F.col("weight") * F.col("value")).alias("m"))
        x = cut(start.join(moved, ["node", "label"], "full").select("node", "label", (F.coalesce("m", F.lit(0.0)) * alpha + F.coalesce("x0", F.lit(0.0)) * (1 - alpha)).alias("value")))
    return x


def _diffused(p: DataFrame, start: DataFrame, n: int, alpha: float, rounds: int) -> DataFrame:
    """The rounds of ``diffuse_columns`` on labels side by side (node, c0, c1, ...), null where a label has not come."""
    names = [f"c{i}" for i in range(n)]
    x, first = start, start.select("node", *(F.col(c).alias(f"{c}_0") for c in names))
    for _ in range(rounds):
        now = lambda c: F.when(F.col(c).isNotNull() | F.col(f"{c}_0").isNotNull(), F.coalesce(c, F.lit(0.0)) * alpha + F.coalesce(f"{c}_0", F.lit(0.0)) * (1 - alpha)).alias(c)
        x = first.join(G.spread(p, x, names), "node", "full").select("node", *map(now, names))
    return x


def assess_enrichment(scores: DataFrame, markers: DataFrame) -> DataFrame:
    """Rank-threshold enrichment of each label in each group of (grp, gene, score).

    Genes are taken by falling score, ties by gene; at each prefix the label's hits are held against the
    expected number by the Bernstein tail. The largest score (base 10) and its first prefix are returned.
    """
    total = scores.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "gene")
    ranked = scores.withColumn("pos", F.row_number().over(w)).join(total, "grp")
    sizes = markers.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # The tail can only peak at a hit: prefixes that end on another gene have the same hits and more expected ones.
    hits = ranked.join(markers.select("label", "gene"), "gene").join(sizes, "label")
    k = F.count(F.lit(1)).over(Window.partitionBy("grp", "label").orderBy("pos"))
    lam = k - F.col("pos") * F.col("size") / F.col("n")
    var = F.col("pos") * F.col("size") / F.col("n") * (1 - F.col("size") / F.col("n"))
    value = F.when(lam > 0, lam * lam / (2 * (var + lam / 3)) / F.log(F.lit(10.0))).otherwise(0.0)
    best = hits.withColumn("value", F.round(value, 9)).groupBy("grp", "label").agg(F.max(F.struct("value", (-F.col("pos")).alias("back"))).alias("b"))
    return best.select("grp", "label", F.col("b.value").alias("log_p"), (-F.col("b.back")).cast("long").alias("threshold"))


def annotate_clusters(specificity: DataFrame, markers: DataFrame) -> DataFrame:
    """Each group's first best label from the upper scores of ``matrix.specificity``."""
    scores = specificity.select("grp", "gene", F.greatest(F.coalesce("upper", F.lit(0.0)), F.lit(0.0)).alias("score"))
    return best_label(assess_enrichment(scores, markers).withColumnRenamed("log_p", "value"), "grp")


def archetype_specificity(x: DataFrame, h: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """Like ``matrix.specificity`` with memberships h (cell, comp, weight), normalised within a component."""
    hn = h.withColumn("h", F.col("weight") / F.sum("weight").over(Window.partitionBy("comp"))).select("cell", "comp", "h")
    rate = x.groupBy("cell").agg((F.count(F.lit(1)) / n_genes).alias("q"))
    mean = rate.agg((F.sum("q") / n_cells).alias("mq"))
    g = F.col("h") * F.col("q") / F.col("mq")
    gamma = hn.join(rate, "cell").join(F.broadcast(mean)).groupBy("comp").agg(F.sum(g).alias("g1"), F.sum(g * g).alias("g2"), F.max(g).alias("gm"))
    gene = x.groupBy("gene").agg((F.count(F.lit(1)) / n_cells).alias("p"), F.avg("value").alias("r"))
    obs = x.join(hn, "cell").groupBy("comp", "gene").agg(F.sum(F.col("value") * F.col("h")).alias("profile"))
    t = obs.join(gene, "gene").join(gamma, "comp")
    lam, nu = F.col("profile") - F.col("p") * F.col("r") * F.col("g1"), F.col("p") * F.col("r") * F.col("r") * F.col("g2")
    up = F.when(lam > 0, lam * lam / (2 * (nu + lam * F.col("r") * F.col("gm") / 3)) / F.log(F.lit(10.0))).otherwise(0.0)
    low = F.when(lam < 0, lam * lam / (2 * nu) / F.log(F.lit(10.0))).otherwise(0.0)
    return t.select("comp", "gene", "profile", up.alias("upper"), low.alias("lower"))


def impute_archetypes(h: DataFrame, profile: DataFrame) -> DataFrame:
    """max(H Z', 0) of memberships (cell, comp, weight) and profiles (comp, gene, value)."""
    v = F.sum(F.col("weight") * F.col("value"))
    return h.join(profile, "comp").groupBy("cell", "gene").agg(F.greatest(v, F.lit(0.0)).alias("value"))


def rescaled(imputed: DataFrame, x: DataFrame) -> DataFrame:
    """Each gene times its largest original over its largest imputed value (1 where that is not positive), and not under 0."""
    top = imputed.groupBy("gene").agg(F.max("value").alias("hi"))
    old = x.groupBy("gene").agg(F.max("value").alias("was"))
    by = F.when(F.col("hi") > 0, F.coalesce("was", F.lit(0.0)) / F.col("hi")).otherwise(1.0)
    return imputed.join(top.join(old, "gene", "left").select("gene", by.alias("by")), "gene").select("cell", "gene", F.greatest(F.col("value") * F.col("by"), F.lit(0.0)).alias("value"))


def impute_diffusion(x: DataFrame, genes: list[int], g: DataFrame, alpha: float = 0.85, rounds: int = 5, code: int = 2) -> DataFrame:
    """The chosen genes' columns, smoothed over the graph with symmetric normalisation and rescaled."""
    some = x.where(F.col("gene").isin(genes))
    start = some.select(F.col("cell").alias("node"), F.col("gene").alias("label"), "value")
    return rescaled(diffuse_columns(g, start, alpha, rounds, code).select(F.col("node").alias("cell"), F.col("label").alias("gene"), "value"), some)


def impute_pca(x: DataFrame, genes: list[int], g: DataFrame, f, alpha: float = 0.85, rounds: int = 5, code: int = 2) -> DataFrame:
    """The chosen genes from a kernel reduction's smoothed cells and its gene side, rescaled; ``f``: ``decomposition.Factors``."""
    from sparkmat.operators.decomposition import smoothed

    base, cells = smoothed(f, g, alpha, rounds, code)
    at = {n: i for i, n in enumerate(base.names)}
    known = sorted({n for n in genes if n in at})
    if not known:
        raise ValueError("none of the genes is in the reduction")
    rows = [(n, base.genes[at[n]].astype(float).tolist()) for n in known]
    side = x.sparkSession.createDataFrame(rows, "gene long, w array<double>")
    value = F.aggregate(F.zip_with("vec", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # The gene side is a row for each gene that the caller names.
    imputed = cells.crossJoin(F.broadcast(side)).select("cell", "gene", value.alias("value"))
    return rescaled(imputed, x.where(F.col("gene").isin(known)))


def xicor(pairs: DataFrame, by: str = "grp") -> DataFrame:
    """Rank correlation xi of y on x within each group of (by, x, y, pos), and z, xi over its deviation if y did not hang on x.

    Ties of x stand in order of pos. A single row or a constant y gives null.
    """
    from sparkmat.operators.network import cut, numbered

    # Places come from sorted ranges and not from a window over a group, which would be a task. A struct is equal to itself with nulls, too.
    t = pairs.select(F.struct(by).alias("_k"), by, "x", "y", "pos")
    t = cut(numbered(t, "_k", "y", "pos", name="_g")).withColumn("_t", F.struct("_k", "y"))
    ties = cut(t.groupBy("_t").agg(F.min("_g").alias("lo"), F.max("_g").alias("hi"))).withColumn("_k", F.col("_t._k"))
    size = ties.groupBy("_k").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + 1).alias("n"))
    ranks = ties.join(size, "_k").withColumn("r", F.col("hi") - F.col("start") + 1).withColumn("l", F.col("start") + F.col("n") - F.col("lo"))
    ranks = cut(ranks.withColumn("s", (F.col("hi") - F.col("lo") + 1).cast("double") * F.col("r")).repartitionByRange("lo").withColumn("_p", F.spark_partition_id()))
    # The deviation needs the ranks in rising order: place q of n, and the running sum v of ranks; before a tie: within its range, and of the ranges before.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranks.groupBy("_p", "_k").agg(F.sum("s").alias("s")).select("_p", "_k", F.coalesce(F.sum("s").over(before.partitionBy("_k").orderBy("_p")), F.lit(0.0)).alias("far"))
    ranks = ranks.withColumn("near", F.coalesce(F.sum("s").over(before.partitionBy("_p", "_k").orderBy("lo")), F.lit(0.0))).join(ranges, ["_p", "_k"])
    t = t.drop("_k").join(ranks.select("_t", "_k", "r", "l", "n", "start", (F.col("near") + F.col("far") - (F.col("lo") - 1).cast("double") * F.col("r")).alias("v")), "_t")
    t = t.select("_k", by, "x", "pos", "r", "l", "n", (F.col("_g") - F.col("start") + 1).alias("q"), (F.col("v") + F.col("_g").cast("double") * F.col("r")).alias("v"))
    t = cut(numbered(t, "_k", "x", "pos", name="_h"))
    last = t.select((F.col("_h") + 1).alias("_h"), F.col("_k").alias("_l"), F.col("r").alias("_r"))
    t = t.join(last, "_h", "left").withColumn("d", F.when(F.col("_k") == F.col("_l"), F.abs(F.col("r") - F.col("_r"))))
    n = F.first("n").cast("double")
    den = 2 * F.sum(F.col("l") * (F.col("n") - F.col("l")))
    xi = 1 - F.first("n") * F.sum("d") / den
    r, rest = F.col("r").cast("double"), F.col("n").cast("double") - F.col("q")
    a = F.sum((2 * rest + 1) * r * r) / (n * n * n * n)
    b = F.sum(F.pow(F.col("v") + rest * r, F.lit(2.0))) / (n * n * n * n * n)
    c = F.sum((2 * rest + 1) * r) / (n * n * n)
    d = den / 2 / (n * n * n)
    deviation = F.sqrt((a - 2 * b + c * c) / (d * d) / n)
    return t.groupBy(by).agg(F.when(den > 0, xi).alias("xi"), F.when((den > 0) & (deviation > 0), xi / deviation).alias("z"))


def xicor_matrix(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b, xi, z) for each column a of x and b of y, both (pos, name, value) with every position in every column."""
    pairs = x.select("pos", F.col("name").alias("a"), F.col("value").alias("x")).join(y.select("pos", F.col("name").alias("b"), F.col("value").alias("y")), "pos")
    keyed = pairs.withColumn("grp", F.struct("a", "b"))
    return xicor(keyed).select("grp.a", "grp.b", "xi", "z")
