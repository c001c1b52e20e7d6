"""Operators on edge lists (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalize_graph(g: DataFrame, code: int = 0) -> DataFrame:
    """0: columns sum to 1; 1: rows sum to 1; 2: divided by the roots of both degrees."""
    out, into = F.sum("weight").over(Window.partitionBy("src")), F.sum("weight").over(Window.partitionBy("dst"))
    return g.withColumn("weight", F.col("weight") / {0: into, 1: out, 2: F.sqrt(out * into)}[code])


#: Labels that a row of a node holds side by side at most.
WIDE = 64


def spread(p: DataFrame, x: DataFrame, columns: list[str], *more) -> DataFrame:
    """(node, sums of weight times each of the ``columns`` over the node's edges, null where all are) of x (node, columns); ``more`` are further sums."""
    return p.join(x.hint("shuffle_hash"), p["dst"] == x["node"]).groupBy(F.col("src").alias("node")).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns), *more)


def side_by_side(scores: DataFrame) -> tuple[DataFrame, list] | None:
    """((node, c0, c1, ...), labels) of (node, label, value), null where there is no row; None over ``WIDE`` labels."""
    labels = sorted(r[0] for r in scores.select("label").distinct().limit(WIDE + 1).collect() if r[0] is not None)
    if len(labels) > WIDE:
        return None
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    return scores.groupBy("node").agg(*(F.sum(F.when(F.col("label") == F.lit(v), value)).alias(f"c{i}") for i, v in enumerate(labels))), labels


def one_by_one(wide: DataFrame, labels: list, kind, key: str = "node") -> DataFrame:
    """(key, label, value) of the columns c0, c1, ... that are not null."""
    cells = F.array(*(F.struct(F.lit(v).cast(kind).alias("label"), F.col(f"c{i}").alias("value")) for i, v in enumerate(labels)))
    return wide.select(key, F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c")).select(key, "c.label", "c.value")


def diffuse(g: DataFrame, scores: DataFrame, alpha: float = 0.85, rounds: int = 5, p: DataFrame | None = None) -> DataFrame:
    """x <- alpha P x + (1 - alpha) x0 on (node, value), P column-normalised (``p``: already, dealt by dst); alpha 0 gives the scores."""
    from sparkmat.operators.network import cut, dealt

    if not alpha or not rounds:
        return scores
    p, start = dealt(normalize_graph(g, 0), "dst") if p is None else p, cut(scores.select("node", "value"))
    x = start
    for _ in range(rounds):
        moved = spread(p, x, ["value"]).withColumnRenamed("value", "m")
        x = start.join(moved, "node", "left").select("node", (F.coalesce("m", F.lit(0.0)) * alpha + F.col("value") * (1 - alpha)).alias("value"))
    return x


def mutual(g: DataFrame) -> DataFrame:
    """Edges whose reverse exists, with the geometric mean of both weights."""
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w"))
    return g.join(back, ["src", "dst"]).select("src", "dst", F.sqrt(F.col("weight") * F.col("w")).alias("weight"))


def label_enrichment(g: DataFrame, scores: DataFrame, n_nodes: int) -> DataFrame:
    """Bernstein score of each (node, label) of neighbours' scores (node, label, value) against the label's mean."""
    from sparkmat.operators.network import cut

    scores = cut(scores)
    found = side_by_side(scores)
    mean = scores.groupBy("label").agg((F.sum("value") / n_nodes).alias("p"))
    if found and found[1]:
        wide, labels = found
        names = [f"c{i}" for i in range(len(labels))]
        x = wide.hint("shuffle_hash")
        rows = g.join(x, g["dst"] == x["node"], "left").groupBy("src").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in names), F.sum("weight").alias("w1"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.max("weight").alias("a"))
        cells = F.array(*(F.struct(F.lit(v).cast(scores.schema["label"].dataType).alias("label"), F.col(c).alias("obs")) for c, v in zip(names, labels)))
        obs = rows.select("src", "w1", "w2", "a", F.explode(F.filter(cells, lambda c: c["obs"].isNotNull())).alias("c")).select("src", "c.label", "c.obs", "w1", "w2", "a")
        t = obs.join(F.broadcast(mean), "label")  # a row a label
    else:
        rows = g.groupBy("src").agg(F.sum("weight").alias("w1"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.max("weight").alias("a"))
        obs = g.join(scores, g["dst"] == scores["node"]).groupBy("src", "label").agg(F.sum(F.col("weight") * F.col("value")).alias("obs"))
        t = obs.join(rows, "src").join(mean, "label")
    lam = F.col("obs") - F.col("w1") * F.col("p")
    den = 2 * (F.col("w2") * F.col("p") + lam * F.col("a") / 3)
    return t.select("src", "label", F.when((lam > 0) & (den > 0), lam * lam / den).otherwise(0.0).alias("score"))


def autocorrelation(g: DataFrame, scores: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of (node, value) over the edges."""
    m = scores.agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("value") * F.col("value")) - F.sum("value") * F.sum("value") / F.count(F.lit(1))).alias("ss"))
    a, b = scores.select(F.col("node").alias("src"), F.col("value").alias("u")), scores.select(F.col("node").alias("dst"), F.col("value").alias("v"))
    e = g.join(a, "src").join(b, "dst").join(F.broadcast(m))
    u, v, w = F.col("u") - F.col("m"), F.col("v") - F.col("m"), F.col("weight")
    return e.agg((F.first("n") * F.sum(w * u * v) / (F.sum(w) * F.first("ss"))).alias("moran"), ((F.first("n") - 1) * F.sum(w * (u - v) * (u - v)) / (2 * F.sum(w) * F.first("ss"))).alias("geary"))


def permuted_autocorrelation(g: DataFrame, scores: DataFrame, permutations: int = 30, seed: int = 0) -> DataFrame:
    """(statistic, value, z, mu, sigma) of Moran's I and Geary's C: values dealt anew to the nodes give the null.

    A permutation deals the i-th value by one seeded hash order to the i-th node by another, so it is a join of
    two numberings; all of them run as one plan.
    """
    from sparkmat.operators.network import cut, numbered

    base = cut(scores.select("node", "value"))
    rounds = base.select(F.lit(-1).alias("i"), "node", "value")
    for i in range(permutations):
        nodes = numbered(base.select("node"), F.xxhash64("node", F.lit(2 * i + seed)), F.col("node"))
        values = numbered(base, F.xxhash64("node", F.lit(2 * i + 1 + seed)), F.col("node")).select("slot", "value")
        rounds = rounds.unionByName(nodes.join(values, "slot").select(F.lit(i).alias("i"), "node", "value"))
    stats = cut(_statistics(g, cut(rounds), range(-1, permutations)))
    long = lambda t: t.select("i", F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in ("moran", "geary")))).alias("s")).select("i", "s.*")
    out, null = long(stats.where("i < 0")).drop("i"), long(stats.where("i >= 0"))
    if not permutations:
        return out.select("statistic", "value", *(F.lit(None).cast("double").alias(c) for c in ("z", "mu", "sigma")))
    stats = null.groupBy("statistic").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    return out.join(stats, "statistic").select("statistic", "value", F.when(F.col("sigma") > 0, (F.col("value") - F.col("mu")) / F.col("sigma")).alias("z"), "mu", "sigma")


def _statistics(g: DataFrame, scores: DataFrame, rounds) -> DataFrame:
    """(i, moran, geary) of (i, node, value), every i on the same nodes.

    Edge sums are taken apart: sum(w u v) is u'Wv, sum(w (u - v)^2) is u'u by row sums, v'v by column sums, less 2 u'Wv;
    so the edges meet the values of many rounds at once, and only at one end.
    """
    from sparkmat.operators.network import cut, dealt

    m = scores.groupBy("i").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("value") * F.col("value")) - F.sum("value") * F.sum("value") / F.count(F.lit(1))).alias("ss")).collect()  # a row a round
    mean = {r.i: r for r in m}
    if not mean:
        return scores.sparkSession.createDataFrame([(i, None, None) for i in rounds], "i int, moran double, geary double")
    known = scores.where(F.col("i") == rounds[0]).select("node")
    e = dealt(g.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi"), "dst")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("into"))
    parts = []
    for at in range(0, len(rounds), WIDE):
        some = [i for i in rounds[at : at + WIDE] if i in mean]
        names = [f"c{k}" for k in range(len(some))]
        x = cut(scores.groupBy("node").agg(*(F.sum(F.when(F.col("i") == i, F.col("value") - F.lit(mean[i].m))).alias(c) for c, i in zip(names, some))))
        near = spread(e, x, names, F.sum("weight").alias("out")).select("node", "out", *(F.col(c).alias(f"{c}_w") for c in names))
        rows = x.join(near, "node", "left").join(into, "node", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        sums = rows.agg(F.sum("out").alias("w"), *(F.sum(F.col(c) * F.col(f"{c}_w")).alias(f"{c}_p") for c in names), *(F.sum(F.col(c) * F.col(c) * (zero("out") + zero("into"))).alias(f"{c}_q") for c in names))
        row = lambda c, i: F.struct(F.lit(i).alias("i"), F.col(f"{c}_p").alias("p"), F.col(f"{c}_q").alias("q"), F.lit(mean[i].n).alias("n"), F.lit(mean[i].ss).cast("double").alias("ss"))
        parts.append(sums.select("w", F.explode(F.array(*(row(c, i) for c, i in zip(names, some)))).alias("r")).select("w", "r.*"))
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t)
    p, q, w, n, ss = (F.col(c) for c in ("p", "q", "w", "n", "ss"))
    return out.where("w is not null").select("i", (n * p / (w * ss)).alias("moran"), ((n - 1) * (q - 2 * p) / (2 * w * ss)).alias("geary"))


def diffuse_chebyshev(g: DataFrame, scores: DataFrame, alpha: float = 0.85, terms: int = 5, code: int = 2) -> DataFrame:
    """(1 - alpha) (I - alpha P)^-1 of (node, value) by a Chebyshev series of ``terms`` terms; tiny negatives of non-negative scores are 0."""
    if not alpha:
        return scores
    from sparkmat.operators.network import cut, dealt

    root = (1 - alpha * alpha) ** 0.5
    beta, lead = (1 - root) / alpha, (1 - alpha) / root
    p = dealt(normalize_graph(g, code), "dst")
    moved = lambda x: p.join(x, p["dst"] == x["node"]).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("value")).alias("m"))
    old = cut(scores.select("node", "value"))
    now = cut(old.select("node").join(moved(old), "node", "left").select("node", F.coalesce("m", F.lit(0.0)).alias("value")))
    # Every term reads the two before it, so each is written once; the sum reads them all.
    parts = [(lead, old), (2 * lead * beta, now)]
    for k in range(2, terms + 1):
        back = old.withColumnRenamed("value", "o")
        old, now = now, cut(back.join(moved(now), "node", "left").select("node", (2 * F.coalesce("m", F.lit(0.0)) - F.col("o")).alias("value")))
        parts.append((2 * lead * beta**k, now))
    total = None
    for c, t in parts:
        t = t.select("node", (F.col("value") * c).alias("value"))
        total = t if total is None else total.unionByName(t)
    total = total.groupBy("node").agg(F.sum("value").alias("value"))
    low = scores.agg(F.min("value").alias("low"))
    return total.crossJoin(F.broadcast(low)).select("node", F.when((F.col("low") >= 0) & (F.col("value") < 0), 0.0).otherwise(F.col("value")).alias("value"))
