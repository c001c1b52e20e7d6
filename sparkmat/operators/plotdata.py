"""Frames that plots are drawn from; drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_positions(points: DataFrame) -> DataFrame:
    """Median x and y by label."""
    return points.groupBy("label").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def transparency(t: DataFrame, factor: float = 1.5, threshold: float = -0.5, value: str = "value") -> DataFrame:
    """alpha: logistic of the z-score (population deviation; NaN and null left out), 1 over the threshold, to the power factor."""
    clean = F.when(~F.isnan(value), F.col(value))
    stats = t.agg(F.avg(clean).alias("_m"), F.stddev_pop(clean).alias("_s"))
    z = F.when(F.col("_s") > 0, (clean - F.col("_m")) / F.col("_s")).otherwise(0.0)
    alpha = F.when(z > threshold, 1.0).otherwise(F.pow(1 / (1 + F.exp(-factor * (z - threshold))), F.lit(float(factor))))
    return t.crossJoin(F.broadcast(stats)).withColumn("alpha", alpha).drop("_m", "_s")


def sort_categories(t: DataFrame, column: str) -> DataFrame:
    """Distinct values with their place: numbers by value, then texts, nulls last."""
    c = F.col("category")
    number = c.try_cast("double")
    place = F.row_number().over(Window.orderBy(c.isNull(), number.isNull(), number, c))
    return t.select(F.col(column).cast("string").alias("category")).distinct().select("category", place.cast("long").alias("place"))


def color_kind(t: DataFrame, column: str, most: int = 50) -> str:
    """'categorical' for texts, booleans and whole numbers of at most ``most`` different values, else 'continuous'."""
    kind = dict(t.dtypes)[column]
    if kind in ("string", "boolean"):
        return "categorical"
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return "categorical" if whole and t.select(column).distinct().limit(most + 1).count() <= most else "continuous"


def palette(categories: DataFrame, colors: list[str]) -> DataFrame:
    """(category, color) of ``sort_categories``, colours in turn."""
    return categories.select("category", F.element_at(F.array(*map(F.lit, colors)), ((F.col("place") - 1) % len(colors) + 1).cast("int")).alias("color"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts in 0 .. 1."""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("long"))), 2, "0") for c in (r, g, b)))


def sample_groups(t: DataFrame, by: str, n: int, key: str, seed: int = 37) -> DataFrame:
    """At most ``n`` rows of each group, the first by a seeded hash of the key; repeatable at any partitioning."""
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key))).where(F.col("_r") <= n).drop("_r")


def box_statistics(t: DataFrame, by: str = "grp", value: str = "value") -> DataFrame:
    """Quartiles, the outermost values within 1.5 quartile ranges, and the number of values outside, by group."""
    q = t.groupBy(by).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return t.join(q, by).groupBy(by, "q1", "q2", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.sum(F.when(inside, 0).otherwise(1)).alias("n_out"))


def violin(t: DataFrame, grid: int = 64) -> DataFrame:
    """(grp, at, width): Gaussian density on a grid, widest 0.4, Scott's bandwidth; groups under two points or without spread have none.

    Points are summed over 16 bins a bandwidth first, so the work of a group does not grow with its rows.
    """
    s = t.groupBy("grp").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 1 and sd > 0")
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    b = t.join(s, "grp").groupBy("grp", "lo", "hi", "h", F.floor(F.col("value") / F.col("h") * 16).alias("bin")).agg(F.count("value").alias("c"), F.avg("value").alias("v"))
    g = s.select(F.col("grp"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (grid - 1))).alias("at"))
    z = (F.col("at") - F.col("v")) / F.col("h")
    d = b.select("grp", "h", "c", "v").join(g, "grp").groupBy("grp", "at").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("d"))
    return d.select("grp", "at", (0.4 * F.col("d") / F.max("d").over(Window.partitionBy("grp"))).alias("width"))


def nudged_positions(points: DataFrame, share: float = 0.02) -> DataFrame:
    """``label_positions``, each coordinate moved by its average rank over the number of labels times ``share`` of the points' range."""
    at = label_positions(points)
    span = points.agg((F.max("x") - F.min("x")).alias("rx"), (F.max("y") - F.min("y")).alias("ry"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    # A row for each label: the window holds the label table.
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    moved = at.crossJoin(F.broadcast(span)).withColumn("n", n).withColumn("kx", average("x")).withColumn("ky", average("y"))
    return moved.select("label", (F.col("x") + F.col("kx") / F.col("n") * F.col("rx") * share).alias("x"), (F.col("y") + F.col("ky") / F.col("n") * F.col("ry") * share).alias("y"))


def darken(color: Column, factor: float = 0.7) -> Column:
    """#rrggbb with each part times ``factor``, cut to whole numbers."""
    part = lambda i: F.lpad(F.lower(F.hex(F.floor(F.conv(F.substring(color, i, 2), 16, 10).cast("double") * factor).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(2), part(4), part(6))


def gradient(value: Column, low: Column, high: Column, colors: list[tuple[float, float, float]]) -> Column:
    """#rrggbb between evenly spaced colours (parts in 0 .. 1) for a value from ``low`` to ``high``; null and NaN stay null."""
    u = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))).otherwise(0.5) * (len(colors) - 1)
    i = F.least(F.floor(u), F.lit(len(colors) - 2)).cast("int")
    at = lambda c, j: F.element_at(F.array(*(F.lit(float(x[c])) for x in colors)), (i + 1 + j).cast("int"))
    parts = [at(c, 0) + (at(c, 1) - at(c, 0)) * (u - i) for c in range(3)]
    return F.when(value.isNotNull() & ~F.isnan(value), hex_color(*parts))


def ordered_points(t: DataFrame, order: str | None, value: str = "value", key: str = "node", seed: int = 37) -> DataFrame:
    """``t`` in drawing order: 'sort' by value (ties by key), 'random' by a seeded hash of the key, None as it is."""
    if order is None:
        return t
    if order not in ("sort", "random"):
        raise ValueError(f"unknown order {order!r}")
    return t.orderBy(F.col(value).asc_nulls_last(), key) if order == "sort" else t.orderBy(F.xxhash64(F.lit(seed), key), key)


def embedding_frame(coords: DataFrame, color: DataFrame | None = None, kind: str = "auto", fade: DataFrame | None = None, vmin: float | None = None, vmax: float | None = None, sample: int | None = None, seed: int = 37) -> DataFrame:
    """(node, x, y, kind, category, amount, missing, alpha) of an embedding plot.

    ``color`` is (node, value): numbers are continuous unless ``kind`` says otherwise and are clamped to vmin and vmax,
    texts categories, unless all of them begin with '#': then they are colours ('rgb'). Nodes without a value are missing.
    ``fade`` (node, value) gives ``transparency``; ``sample`` nodes are picked by a seeded hash.
    """
    if kind not in ("auto", "categorical", "continuous"):
        raise ValueError(f"unknown kind {kind!r}")
    t = coords.select("node", "x", "y")
    if sample is not None:
        if sample < 1:
            raise ValueError("a sample has one point or more")
        t = t.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sample)
    none = lambda c: F.lit(None).cast(c)
    if color is None:
        t = t.select("*", F.lit("none").alias("kind"), none("string").alias("category"), none("double").alias("amount"), F.lit(False).alias("missing"))
    else:
        if kind == "auto":
            if dict(color.dtypes)["value"] in ("string", "boolean"):
                seen = color.where("value is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith(F.col("value").cast("string"), F.lit("#"))).alias("c")).first()
                kind = "rgb" if seen.n and seen.n == seen.c else "categorical"
            else:
                kind = "continuous"
        t = t.join(color.select("node", "value"), "node", "left")
        amount = F.col("value").cast("double") if kind == "continuous" else none("double")
        amount = F.when(~F.isnan(amount), amount)
        category = none("string") if kind == "continuous" else F.col("value").cast("string")
        missing = amount.isNull() if kind == "continuous" else category.isNull()
        clamped = amount if vmin is None else F.greatest(amount, F.lit(float(vmin)))
        clamped = clamped if vmax is None else F.least(clamped, F.lit(float(vmax)))
        t = t.select("node", "x", "y", F.lit(kind).alias("kind"), category.alias("category"), F.when(~missing, clamped).alias("amount"), missing.alias("missing"))
    if fade is None:
        return t.withColumn("alpha", F.lit(1.0))
    return t.join(transparency(fade.select("node", "value")).select("node", "alpha"), "node", "left").withColumn("alpha", F.coalesce("alpha", F.lit(1.0)))


def feature_frames(coords: DataFrame, values: DataFrame, order: str | None = "sort") -> DataFrame:
    """(gene, node, x, y, value, pane_row, pane_column): every node for each gene of (cell, gene, value), panes in a square grid by gene."""
    genes = values.select("gene").distinct().withColumn("pane", F.row_number().over(Window.orderBy("gene")) - 1)  # a row for each gene that is drawn
    n = genes.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("side"))
    frame = coords.select("node", "x", "y").crossJoin(F.broadcast(genes.crossJoin(F.broadcast(n))))
    t = frame.join(values.select(F.col("cell").alias("node"), "gene", "value"), ["node", "gene"], "left")
    out = t.select("gene", "node", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"), F.floor(F.col("pane") / F.col("side")).cast("int").alias("pane_row"), (F.col("pane") % F.col("side")).cast("int").alias("pane_column"))
    return ordered_points(out, order)


def qc_frame(x: DataFrame, cells: DataFrame, genes: DataFrame, groups: DataFrame, metric: str = "percent", log: str | None = None) -> DataFrame:
    """(cell, grp, value) of a QC violin: ``matrix.feature_abundance`` of (gene) ``genes``, on request through a logarithm."""
    from sparkmat.functions import log_of
    from sparkmat.operators.matrix import feature_abundance

    t = feature_abundance(x, genes, cells, metric, groups=groups)
    value = F.col(metric) if log is None else log_of(F.col(metric), log)
    return t.select("cell", "grp", value.alias("value"))


def mito_frame(x: DataFrame, cells: DataFrame, var: DataFrame, groups: DataFrame, species: str = "hsapiens", protein_coding: bool = False, metric: str = "percent") -> DataFrame:
    """``qc_frame`` of the mitochondrial genes among (gene, name) ``var``; none among them is an error."""
    from sparkmat.functions.mitochondria import mito_features

    genes = var.where(F.col("name").isin(mito_features("gene_name", species, protein_coding))).select("gene")
    if not genes.limit(1).count():
        raise ValueError(f"no mitochondrial gene of {species} is among the features")
    return qc_frame(x, cells, genes, groups, metric)
