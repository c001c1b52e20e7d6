"""Neighbour networks and what is computed on them: edge lists (src, dst, weight), vectors (cell, vec).

Iterations write their state to the checkpoint folder, so plans stay short and lost executors lose nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.operators import graph as G


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkmat-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` (a temporary folder only in local mode where that is unset) and read it again.

    A checkpoint would keep the size estimate of the plan it replaces, which a loop of joins multiplies without end;
    a table read again has its true size.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkmat_path = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``cut`` into buckets of ``key``: joins and sums by it move only what is small beside ``df``, in as many tasks as shuffles have."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = folder(spark)
    name = f"state_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{root}/{name}").saveAsTable(name)
    return spark.table(name)


def drop(*tables: DataFrame) -> None:
    """Remove what ``cut`` wrote; nothing may read it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._sparkmat_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "slot") -> DataFrame:
    """``df`` with its rows' places, from 0, in that order: ranges are sorted apart and offset by the sizes before them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_p int, _b long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def undirected(g: DataFrame) -> DataFrame:
    """Each edge of a symmetric graph once, loops kept."""
    return g.where("src <= dst")


def _unit(a: np.ndarray, metric: str) -> np.ndarray:
    if metric == "jsd":
        return a / np.maximum(np.abs(a).sum(1, keepdims=True), 1e-300)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300) if metric == "ip" else a


def _distance(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1 - q @ b.T
    if metric == "l2":
        return np.sqrt(np.maximum(np.round((q * q).sum(1)[:, None] + (b * b).sum(1) - 2 * q @ b.T, 12), 0))
    h = lambda p: np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1)
    return np.stack([np.sqrt(np.maximum(h(b) / 2 + h(r) / 2 - h((b + r) / 2), 0)) for r in q])


#: Bytes of candidates that a task of ``neighbours`` holds; tasks that small tables are dealt over; base rows compared at once.
HELD, TASKS, SLAB = 256 << 20, 48, 1024


class _Nearest:
    """The k nearest so far of n queries. Base rows come by rising id, so of equal distances the earlier columns stay."""

    def __init__(self, n: int, k: int):
        self.k, self.room = k, k + max(k // 2, SLAB)
        self.d, self.id = np.full((n, self.room), np.inf), np.zeros((n, self.room), np.int64)
        self.n, self.limit = np.zeros(n, np.int64), np.full(n, np.inf)

    def add(self, lo: int, own: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Distances of the queries from ``lo`` on, whose ids are ``own``, to the base rows ``ids``."""
        hi = lo + len(d)
        row, col = np.divmod(np.flatnonzero(d <= self.limit[lo:hi, None]), d.shape[1])
        other = (own[row] != ids[col]) & np.isfinite(d[row, col])
        row, col = row[other], col[other]
        new = np.bincount(row, minlength=hi - lo)
        if (self.n[lo:hi] + new).max(initial=0) > self.room:
            self._shorten(lo, hi)
        at = self.n[lo:hi][row] + np.arange(len(row)) - (np.cumsum(new) - new)[row]
        self.d[lo + row, at], self.id[lo + row, at] = d[row, col], ids[col]
        self.n[lo:hi] += new
        if self.n[lo:hi].max(initial=0) >= self.k + max(self.k // 2, 64):
            self._shorten(lo, hi)

    def _shorten(self, lo: int, hi: int) -> None:
        """Back to the k nearest, in the order in which they came."""
        used = int(self.n[lo:hi].max(initial=0))
        if used <= self.k:
            return
        d = np.round(self.d[lo:hi, :used], 12)
        last = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        less, tie = d < last, d == last
        keep = less | tie & (np.cumsum(tie, axis=1) <= self.k - less.sum(1, keepdims=True))
        for t in (self.d, self.id):
            t[lo:hi, : self.k] = t[lo:hi, :used][keep].reshape(hi - lo, self.k)
        self.d[lo:hi, self.k : used] = np.inf
        self.n[lo:hi] = np.minimum(self.n[lo:hi], self.k)
        self.limit[lo:hi] = last[:, 0] + 1e-12  # rounded distances are compared again

    def ranked(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of some queries, nearest first; the distances of missing ones are infinite."""
        self._shorten(lo, hi)
        d, ids = self.d[lo:hi, : self.k], self.id[lo:hi, : self.k]
        order = np.argsort(np.round(d, 12), axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def _packed(width: int):
    """Pieces (list, first, ids, vecs, wide) of (list, cell, vec), a few rows each as bytes; doubles that are floats are sent as such."""
    rows = max(1, 1024 // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at, cell, flat = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != width * t.num_rows:
                raise ValueError("vectors are not of one length")
            vec = flat.reshape(t.num_rows, width)
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                for i in range(a, b, rows):
                    v = vec[i : min(i + rows, b)]
                    short = v.astype(np.float32)
                    wide = not (short == v).all()
                    out.append((int(at[a]), int(cell[i]), cell[i : min(i + rows, b)].tobytes(), (v if wide else short).tobytes(), wide))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], ["list", "first", "ids", "vecs", "wide"])

    return run


def _slabs(batch: pa.RecordBatch, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(query?, ids, rows) of the pieces of (grp, base, first, ids, vecs, wide) in order."""
    base, wide, ids, vecs = (batch.column(i).to_pylist() for i in (1, 5, 3, 4))
    per, i = max(1, SLAB // max(1, 1024 // max(width, 1))), 0
    while i < len(base):
        j = i + 1
        while j < min(i + per, len(base)) and base[j] == base[i]:
            j += 1
        rows = [np.frombuffer(v, np.float64 if w else np.float32).reshape(-1, width) for v, w in zip(vecs[i:j], wide[i:j])]
        yield not base[i], np.frombuffer(b"".join(ids[i:j]), np.int64), np.concatenate(rows).astype(np.float64)
        i = j


def neighbours(vectors: DataFrame, k: int = 10, metric: str = "l2", lists: int = 16, probes: int | None = None, block: int = 8192, ranked=None) -> DataFrame:
    """(src, dst, distance): each cell's k nearest others, ties to the smaller id.

    A task has at most about ``block`` queries (fewer for many neighbours) and reads the rows past them in the order
    of their ids, so what it holds does not grow with the table, and each query's result is whole in one task. With
    fewer ``probes`` than ``lists``, as many centres are drawn from the rows by hash, rows belong to their nearest
    centre, queries go to their ``probes`` nearest, and what is found there is merged. NaN or infinite components are an error.
    ``ranked``, for exact searches, turns (ids, distances) of some queries, nearest first, into (kept?, values) instead.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("cell").cast("long").alias("cell"), F.col("vec").cast("array<double>").alias("vec"))
    bad = F.col("vec").isNull() | F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    n, bad, width = v.agg(F.count(F.lit(1)), F.max(bad), F.max(F.size("vec"))).first()
    if bad:
        raise ValueError("vectors hold NaN or infinite components")
    if n == 0:
        return spark.createDataFrame([], "src long, dst long, distance double")
    held = 16 * (k + max(k // 2, SLAB))
    room = max(1, min(block, HELD // held, max(256, -(-n // TASKS))))
    pieces = lambda t: cut(t.repartitionByRange("list", "cell").sortWithinPartitions("list", "cell").mapInArrow(_packed(width), "list int, first long, ids binary, vecs binary, wide boolean").withColumn("piece", F.monotonically_increasing_id()))
    if not probes or probes >= lists:
        base = query = pieces(v.select(F.lit(0).alias("list"), "cell", "vec"))
        sizes = {0: n}
    else:
        centres = _unit(np.array([r.vec for r in v.orderBy(F.xxhash64("cell")).limit(lists).select("vec").collect()]), metric)

        def place(times: int):
            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for t in parts:
                    d = _distance(_unit(np.stack(t["vec"].to_numpy()), metric), centres, metric) if len(t) else np.zeros((0, 1))
                    near = np.argsort(d, axis=1, kind="stable")[:, :times]
                    at = np.repeat(np.arange(len(t)), near.shape[1])
                    yield pd.DataFrame({"list": near.ravel(), "cell": t["cell"].to_numpy()[at], "vec": t["vec"].to_numpy()[at]})

            return v.mapInPandas(run, "list int, cell long, vec array<double>")

        base, query = pieces(place(1)), pieces(place(probes))
        sizes = {r["list"]: r["n"] for r in query.groupBy("list").agg(F.sum(F.length("ids") / 8).cast("long").alias("n")).collect()}  # a row a list
    firsts, total = [], 0
    for at in sorted(sizes):
        firsts.append((at, total, -(-sizes[at] // room)))
        total += firsts[-1][2]
    groups = F.broadcast(spark.createDataFrame(firsts, "list int, from int, times int"))
    of = F.pmod(F.xxhash64("piece"), F.col("times")).cast("int")
    query = query.join(groups, "list").select((F.col("from") + of).alias("grp"), F.lit(0).alias("base"), "first", "ids", "vecs", "wide")
    base = base.join(groups, "list").select(F.explode(F.sequence(F.col("from"), F.col("from") + F.col("times") - 1)).alias("grp"), F.lit(1).alias("base"), "first", "ids", "vecs", "wide")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, best = [], [], None
        for batch in batches:
            for is_query, ids, b in _slabs(batch, width):
                if is_query:
                    own.append(ids)
                    rows.append(_unit(b, metric))
                    continue
                if best is None:
                    if not own:
                        return  # a group that no query was dealt to
                    own, rows = np.concatenate(own), np.concatenate(rows)
                    best = _Nearest(len(own), k)
                b = _unit(b, metric)
                for lo in range(0, len(own), 512):
                    best.add(lo, own[lo : lo + 512], ids, _distance(rows[lo : lo + 512], b, metric))
        for lo in range(0, len(own) if best is not None else 0, max(1, min(512, (1 << 18) // k))):
            hi = min(len(own), lo + max(1, min(512, (1 << 18) // k)))
            ids, d = best.ranked(lo, hi)
            keep, value = ranked(ids, d) if ranked else (np.isfinite(d), d)
            at = np.repeat(np.arange(lo, hi), keep.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[keep]), pa.array(value[keep])], ["src", "dst", "distance"])

    dealt = query.unionByName(base).repartitionById(total, F.col("grp")).sortWithinPartitions("base", "first")
    found = dealt.mapInArrow(search, "src long, dst long, distance double")
    if not probes or probes >= lists:
        return found
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("distance", 12), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "distance")


def knn_network(vectors: DataFrame, k: int = 10, metric: str = "l2", mutual: bool = True, **search) -> DataFrame:
    """Edges to the k nearest neighbours, weight 1 - distance / largest distance; mutual ones only by default."""
    d = cut(neighbours(vectors, k, metric, **search))  # read three times
    top = d.agg(F.max("distance").alias("top"))
    g = d.crossJoin(F.broadcast(top)).select("src", "dst", F.when(F.col("top") > 0, 1 - F.col("distance") / F.col("top")).otherwise(1.0).alias("weight"))
    return G.mutual(g) if mutual else g


def kstar_weights(d: DataFrame, density: float = 1.0) -> DataFrame:
    """Adaptive neighbours of (src, dst, distance): the shortest prefix where lambda_k <= beta_(k+1), weights lambda - beta."""
    w = Window.partitionBy("src").orderBy(F.round("distance", 12), "dst")  # as neighbours ranks them
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = d.withColumn("beta", F.col("distance") * density).withColumn("k", F.row_number().over(w))
    t = t.withColumn("s", F.sum("beta").over(run)).withColumn("q", F.sum(F.col("beta") * F.col("beta")).over(run)).withColumn("next", F.lead("beta").over(w))
    inside = F.greatest(F.col("k") + F.col("s") * F.col("s") - F.col("k") * F.col("q"), F.lit(0.0))
    t = t.withColumn("lam", (F.col("s") + F.sqrt(inside)) / F.col("k"))
    stop = F.when(F.col("next").isNull() | (F.col("lam") <= F.col("next")), F.struct("k", "lam"))
    t = t.withColumn("stop", F.min(stop).over(Window.partitionBy("src"))).where(F.col("k") <= F.col("stop.k"))
    weight = F.greatest(F.col("stop.lam") - F.col("beta"), F.lit(0.0))
    return t.select("src", "dst", (weight / F.sum(weight).over(Window.partitionBy("src"))).alias("weight"))


def _kstar_prefix(d: np.ndarray, density: float) -> tuple[np.ndarray, np.ndarray]:
    """``kstar_weights`` of rows of rising distances, infinite where there are none: (kept?, weight)."""
    there = np.isfinite(d)
    beta = np.where(there, d, 0.0) * density
    k = np.arange(1, d.shape[1] + 1)
    s, q = np.cumsum(beta, axis=1), np.cumsum(beta * beta, axis=1)
    lam = (s + np.sqrt(np.maximum(k + s * s - k * q, 0))) / k
    after = np.hstack([np.where(there[:, 1:], beta[:, 1:], np.inf), np.full((len(d), 1), np.inf)])
    stop = np.argmax(lam <= after, axis=1)[:, None]
    keep = there & (k <= stop + 1)
    weight = np.where(keep, np.maximum(np.take_along_axis(lam, stop, 1) - beta, 0), 0.0)
    return keep, weight / np.maximum(weight.sum(1, keepdims=True), 1e-300)


def kstar_network(vectors: DataFrame, density: float = 1.0, metric: str = "jsd", mutual: bool = True, **search) -> DataFrame:
    """Adaptive neighbours among the 5 sqrt(n) nearest; an exact search weighs them where it finds them, so that only the prefixes leave the task."""
    k = max(1, int(5 * vectors.count() ** 0.5))
    if (search.get("probes") or search.get("lists", 16)) < search.get("lists", 16):
        g = kstar_weights(neighbours(vectors, k, metric, **search), density)
    else:
        g = neighbours(vectors, k, metric, ranked=lambda ids, d: _kstar_prefix(d, density), **search).withColumnRenamed("distance", "weight")
    return G.mutual(cut(g)) if mutual else g


def nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("src").alias("node")).union(g.select("dst")).distinct()


def pagerank(g: DataFrame, alpha: float = 0.9, rounds: int = 5) -> DataFrame:
    """Diffusion of 1 / n on every node; alpha is clipped to 0 .. 0.99."""
    p = dealt(G.normalize_graph(g, 0), "dst")
    every = cut(nodes(p))
    start = every.select("node", F.lit(1 / max(every.count(), 1)).alias("value"))
    return G.diffuse(g, start, min(max(alpha, 0.0), 0.99), rounds, p)


def local_pagerank(g: DataFrame, labels: DataFrame, alpha: float = 0.9, rounds: int = 5) -> DataFrame:
    """Diffusion of each label's normalised indicator, over its largest value; a node's largest over all labels."""
    from sparkmat.operators.annotation import diffuse_columns

    start = cut(labels).withColumn("value", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("label")))
    x = diffuse_columns(g, start, min(max(alpha, 0.0), 0.99), rounds)
    top = x.groupBy("label").agg(F.max("value").alias("top"))
    return x.join(top, "label").groupBy("node").agg(F.max(F.col("value") / F.col("top")).alias("value"))


def coreness(g: DataFrame) -> DataFrame:
    """k-shell number of every node, by rounds of h-indices of the neighbours' numbers until nothing changes.

    Loops count for nothing, edges count once whatever their weight. The h-index rounds need no peeling order:
    a few dozen jobs settle graphs whose peeling would take one job a shell; a chain takes a round for every two nodes.
    A round judges only nodes with a neighbour whose number has fallen below theirs; no other number can change.
    """
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = dealt(g.select(F.explode(ways).alias("e")).select("e.*").distinct(), "dst")  # loops stay for their nodes
    known = cut(e.select(F.col("dst").alias("node")).distinct())
    e = e.where("src <> dst")
    x = cut(e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("core")).withColumn("fell", F.lit(True)))
    while True:
        fell = x.where("fell").select("node", F.col("core").alias("low"))
        low = e.join(fell.hint("shuffle_hash"), e["dst"] == fell["node"]).groupBy("src").agg(F.min("low").alias("low"))
        open_ = x.join(low, x["node"] == low["src"]).where("low < core").select("node", F.col("core").alias("own"))
        near = e.join(open_.hint("shuffle_hash"), e["dst"] == open_["node"]).select("node", "own", "src")
        seen = near.join(x.select(F.col("node").alias("src"), "core").hint("shuffle_hash"), "src").groupBy("node", F.least("core", "own").alias("core")).agg(F.count(F.lit(1)).alias("n"))
        # The largest h with h neighbours of h or more: numbers over the own one count as it.
        upto = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("core")))
        now = seen.withColumn("r", upto).groupBy("node").agg(F.max(F.least("r", "core")).cast("long").alias("h"))
        old, x = x, cut(x.join(now, "node", "left").select("node", F.coalesce("h", "core").alias("core"), F.coalesce(F.col("h") < F.col("core"), F.lit(False)).alias("fell")))
        drop(old)
        if not x.where("fell").limit(1).count():
            break
    return known.join(x, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("coreness"))


def same_label(g: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges within a label of (node, label); unlabelled nodes have none."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("l")), labels.select(F.col("node").alias("dst"), F.col("label").alias("l"))
    return g.join(a, "src").join(b, ["dst", "l"]).select("src", "dst", "weight")


def local_coreness(g: DataFrame, labels: DataFrame) -> DataFrame:
    return coreness(same_label(g, labels))


def propagate_labels(g: DataFrame, labels: DataFrame, rounds: int = 3, self_weight: float = 1.0, least: float = 3.0, fixed: list[int] | None = None) -> DataFrame:
    """A node takes the label most enriched among its neighbours and itself where the score is over ``least``."""
    labels, fixed = cut(labels), fixed or []
    n = labels.count()
    e = g.where("src <> dst").unionByName(labels.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(float(self_weight)).alias("weight")))
    e, x = dealt(e, "dst"), labels
    for _ in range(rounds):
        s = G.label_enrichment(e, x.withColumn("value", F.lit(1.0)), n)
        best = s.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("label").alias("to"))).alias("b"))
        moves = (-F.col("b.s") > least) & ~F.col("node").isin(fixed) if fixed else -F.col("b.s") > least
        x = cut(x.join(best, "node", "left").select("node", F.when(moves, F.col("b.to")).otherwise(F.col("label")).alias("label")))
    return x


def modularity(g: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of (node, label) on a symmetric graph."""
    total = g.agg(F.sum("weight").alias("m2"))
    deg = g.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")).join(labels, "node").groupBy("label").agg(F.sum("d").alias("k"))
    inner = same_label(g, labels).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inner"))
    return deg.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).crossJoin(F.broadcast(inner)).crossJoin(F.broadcast(total)).select((F.col("inner") / F.col("m2") - resolution * F.col("kk") / F.col("m2") / F.col("m2")).alias("modularity"))


def cluster(g: DataFrame, resolution: float = 1.0, objective: str = "modularity", rounds: int = 1000, seed: int = 0, enough: int = 0) -> DataFrame:
    """(node, label): communities of a symmetric graph by rounds of gainful moves, then of the contracted graph.

    In a round half the nodes, by a seeded hash, move to the neighbouring community of largest gain at once;
    a level ends when none moves, the whole when a level merges nothing. Labels are the smallest node inside. Nodes that move at once can undo each
    other, so an end is not proven: a level that still moves after ``rounds`` is an error. Levels end early where at most ``enough`` edges are left.
    """
    if objective not in ("modularity", "CPM"):
        raise ValueError(f"unknown objective {objective!r}")
    at = cut(nodes(g).select("node", F.col("node").alias("label")))
    e, size = cut(g.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))), cut(nodes(g).select("node", F.lit(1.0).alias("size")))
    total = e.agg(F.sum("weight")).first()[0] or 1.0
    while True:
        if objective == "CPM":
            own = size.withColumnRenamed("size", "d")
            scale = 1.0
        else:
            own = size.select("node").join(e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w")), "node", "left").select("node", F.coalesce("w", F.lit(0.0)).alias("d"))
            scale = total
        own = cut(own)
        x = own.select("node", F.col("node").alias("label"), "d")
        quiet = 0
        for r in range(rounds):
            mass = x.groupBy("label").agg(F.sum("d").alias("mass"))
            near = e.where("src <> dst").join(x.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
            here = x.select("node", F.col("label").alias("old"), "d")
            options = near.unionByName(x.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w")).join(mass, "label").join(here, "node")
            rest = F.col("mass") - F.when(F.col("label") == F.col("old"), F.col("d")).otherwise(0.0)
            gain = F.round(F.col("w") - resolution * F.col("d") * rest / scale, 9)
            stay = F.when(F.col("label") == F.col("old"), 0).otherwise(1)
            best = options.groupBy("node").agg(F.min(F.struct((-gain).alias("g"), stay.alias("stay"), F.col("label"))).alias("b"))
            turn = F.pmod(F.xxhash64("node", F.lit(seed + r // 2)), F.lit(2)) == r % 2
            y = cut(here.join(best, "node").select("node", F.when(turn, F.col("b.label")).otherwise(F.col("old")).alias("label"), "d", (turn & (F.col("b.label") != F.col("old"))).alias("moved")))
            quiet = 0 if y.where("moved").limit(1).count() else quiet + 1
            x = y.drop("moved")
            if quiet == 2:
                break
        else:
            raise RuntimeError(f"communities still move after {rounds} rounds")
        names = x.withColumn("to", F.min("node").over(Window.partitionBy("label"))).select("node", "to")
        at = cut(at.join(names, at["label"] == names["node"]).select(at["node"], F.col("to").alias("label")))
        if not names.where("node <> to").limit(1).count():
            break
        a, b = names.select(F.col("node").alias("src"), F.col("to").alias("s")), names.select(F.col("node").alias("dst"), F.col("to").alias("t"))
        e = cut(e.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("weight").alias("weight")))
        if e.count() <= enough:
            break
        size = cut(size.join(names, "node").groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("size")))
    return at


#: method -> curve (a, b), repulsion's strength and its least squared distance; a node's own factor comes in with leopold.
LAYOUTS = {"umap": (0.583, 1.334, 1.0, 0.001), "tumap": (1.0, 1.0, 1.0, 0.001), "largevis": (1.0, 1.0, 7.0, 0.1), "leopold": (1.0, 1.0, 1.0, 0.001), "leopold2": (1.0, 1.0, 1.0, 0.001)}


def layout(g: DataFrame, start: DataFrame, epochs: int = 30, rate: float = 1.0, negatives: int = 5, a: float | None = None, b: float | None = None, seed: int = 0, method: str = "umap", factors: DataFrame | None = None) -> DataFrame:
    """(node, coordinates) by synchronous epochs of attraction along edges and repulsion from hashed other nodes.

    Every node draws ``negatives`` partners an epoch by position of a hash ring, so repulsion is a join and never
    all pairs. ``start`` is (node, one column a dimension); a step is clipped to 4 as usual. leopold and leopold2
    scale squared distances by ``factors`` (node, ai[, aj]): by the node's own, or by the root of both nodes'.
    """
    if method not in LAYOUTS:
        raise ValueError(f"unknown method {method!r}")
    needs = {"leopold": ["ai"], "leopold2": ["ai", "aj"]}.get(method, [])
    if needs and (factors is None or not set(needs) <= set(factors.columns)):
        raise ValueError(f"{method} needs {' and '.join(needs)}")
    given_a, given_b, strength, least = LAYOUTS[method]
    a, b = given_a if a is None else a, given_b if b is None else b
    clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    dims = [c for c in start.columns if c != "node"]
    n = start.count()
    ids = cut(numbered(start.select("node"), "node")) if n else None
    x = start
    if n > 1 and epochs:
        top = g.agg(F.max("weight")).first()[0] or 1.0
        e = dealt(g.where("src <> dst").select("src", "dst", (F.col("weight") / top).alias("weight")), "dst")
    one = F.lit(1.0)
    left_of = {"leopold": "ai", "leopold2": "ai"}.get(method)
    for epoch in range(epochs if n > 1 else 0):
        step = rate * (1 - epoch / epochs)
        y = x.join(factors, "node") if needs else x
        own = [*(F.col(c).alias(f"{c}_1") for c in dims), (F.col(left_of) if left_of else one).alias("f1")]
        other = [*(F.col(c).alias(f"{c}_2") for c in dims), (F.col("aj") if method == "leopold2" else one).alias("f2")]
        p, q = y.select(F.col("node").alias("src"), *own), y.select(F.col("node").alias("dst"), *other)
        apart = {c: F.col(f"{c}_1") - F.col(f"{c}_2") for c in dims}
        k = F.sqrt(F.col("f1") * F.col("f2")) if method == "leopold2" else F.col("f1")
        d2 = sum((v * v for v in apart.values()), F.lit(0.0))
        curve = a * k * F.pow(d2, F.lit(b))
        pull = F.when(d2 > 0, -2 * a * b * k * F.pow(d2, F.lit(b - 1)) / (1 + curve)).otherwise(0.0) * F.col("weight")
        # Edges lie by dst; they move once, with the other end's place, to where their forces are summed.
        near = e.join(q.hint("shuffle_hash"), "dst").join(p.hint("shuffle_hash"), "src").groupBy(F.col("src").alias("node")).agg(*(F.sum(clip(pull * v)).alias(f"{c}_n") for c, v in apart.items()))
        push = 2 * strength * b / ((least + d2) * (1 + curve)) / negatives
        slots = F.array(*(F.pmod(F.xxhash64("src", F.lit(seed), F.lit(epoch), F.lit(i)), F.lit(n)) for i in range(negatives)))
        far = p.withColumn("slot", F.explode(slots)).join(q.join(ids.withColumnRenamed("node", "dst"), "dst"), "slot").where("src <> dst").groupBy(F.col("src").alias("node")).agg(*(F.sum(clip(push * v)).alias(f"{c}_f") for c, v in apart.items())) if negatives else None
        force = x.join(near, "node", "left")
        force = force if far is None else force.join(far, "node", "left")
        moved = lambda c: sum((F.coalesce(F.col(f"{c}_{f}"), F.lit(0.0)) for f in ("nf" if negatives else "n")), F.lit(0.0))  # noqa: B023, E731
        after = cut(force.select("node", *((F.col(c) + step * clip(moved(c))).alias(c) for c in dims)))
        if epoch:
            drop(x)
        x = after
    return x


def standard_start(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """(node, x, y[, z ...]): the first ``dims`` components of (cell, vec) less their mean over their deviation (ddof 0)."""
    names = [*"xyz", *(f"x{i}" for i in range(3, dims))][:dims]
    wide = vectors.select(F.col("cell").alias("node"), *(F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(names)))
    stats = wide.agg(*(f(c).alias(f"{c}_{k}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    unit = {c: F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(0.0) for c in names}
    return wide.crossJoin(F.broadcast(stats)).select("node", *(v.alias(c) for c, v in unit.items()))


def _gamma(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)))


def node_colors(coords: DataFrame) -> DataFrame:
    """(node, r, g, b) in 0 .. 1 of (node, a, b, c): three coordinates scaled to the Lab box, then to sRGB."""
    span = coords.agg(*(f(c).alias(f"{c}_{k}") for c in "abc" for k, f in (("lo", F.min), ("hi", F.max))))
    unit = {c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(0.5) for c in "abc"}
    # CIE Lab to XYZ under D65, XYZ to linear sRGB.
    white = (0.95047, 1.0, 1.08883)
    rgb = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    t = coords.crossJoin(F.broadcast(span)).select("node", (20 + 70 * unit["a"]).alias("L"), (160 * unit["b"] - 80).alias("A"), (160 * unit["c"] - 80).alias("B"))
    fy = (F.col("L") + 16) / 116
    f = [fy + F.col("A") / 500, fy, fy - F.col("B") / 200]
    xyz = [w * F.when(v > 6 / 29, v * v * v).otherwise(3 * (6 / 29) ** 2 * (v - 4 / 29)) for w, v in zip(white, f)]
    linear = [sum((m * v for m, v in zip(row, xyz)), F.lit(0.0)) for row in rgb]
    return t.select("node", *(_gamma(v).alias(c) for c, v in zip("rgb", linear)))


def embedding_colors(vectors: DataFrame) -> DataFrame:
    """(node, r, g, b) of (cell, vec) with three components or more: ``node_colors`` of their three leading principal axes."""
    from sparkmat.operators.decomposition import gram, multiply, signs

    width = len(vectors.first().vec)
    if width < 3:
        raise ValueError("colours need three components or more")
    mean = np.array(vectors.agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(width))).alias("m")).first().m)
    centred = vectors.select("cell", F.zip_with("vec", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m).alias("vec"))
    w, e = np.linalg.eigh(gram(centred, width))
    axes = e[:, np.argsort(-w)[:3]]
    t = multiply(centred, axes * signs(axes))
    return node_colors(t.select(F.col("cell").alias("node"), *(F.col("vec")[i].alias(c) for i, c in enumerate("abc"))))


def match_by_rank(u: DataFrame, v: DataFrame, u_least: float = 0, v_least: float = 0) -> DataFrame:
    """Matching for rank-one weights of (id, value): the i-th largest of u with the i-th largest of v, over the limits."""
    rank = lambda t, name, least: numbered(t.where(F.col("value") > least), F.desc("value"), F.asc("id"), name="rank").select(F.col("id").alias(name), (F.col("rank") + 1).alias("rank"))
    return rank(u, "u", u_least).join(rank(v, "v", v_least), "rank").select("u", "v", F.col("rank").cast("long").alias("rank"))


def assignment(w: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of largest total weight of a small dense matrix, by shortest augmenting paths; weights under 0 are left out."""
    r, c = w.shape
    n = max(r, c)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : r + 1, 1 : c + 1] = -np.maximum(w, 0)
    u, v, p, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        p[0], j0, least, used = i, 0, np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            cur = cost[p[j0]] - u[p[j0]] - v
            better = ~used & (cur < least)
            better[0] = False
            least[better], way[better] = cur[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            delta = free[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sorted((int(p[j]) - 1, j - 1) for j in range(1, n + 1) if p[j] <= r and j <= c and w[p[j] - 1, j - 1] > 0)
