"""Leiden communities: moves, refinement and contraction in memory, for graphs whose edges are few enough to gather.

A larger graph is first shrunk where it is, by ``network.cluster``, until it is few enough; what is gathered then is a row
for each pair of its communities. A graph that stays too large keeps the communities found so far.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmat.operators.network import cluster, cut, nodes

#: Edges (both directions, 24 bytes each) that the driver gathers at most: 144 MB.
MOST_EDGES = 6_000_000


class _Graph:
    """Neighbours of each node without itself, node masses, and what masses are divided by in the quality."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, mass: np.ndarray, scale: float):
        order = np.argsort(src, kind="stable")
        src, dst, weight = src[order], dst[order], weight[order]
        apart = src != dst
        self.n, self.mass, self.scale = len(mass), mass, scale
        self.src, self.dst, self.weight = src, dst, weight
        self.begin = np.searchsorted(src[apart], np.arange(self.n + 1)).tolist()
        self.to, self.w = dst[apart], weight[apart]

    def near(self, v: int) -> tuple[list[int], list[float]]:
        a, b = self.begin[v], self.begin[v + 1]
        return self.to[a:b].tolist(), self.w[a:b].tolist()

    def contracted(self, label: np.ndarray) -> _Graph:
        k = int(label.max()) + 1
        key = label[self.src] * k + label[self.dst]
        found, back = np.unique(key, return_inverse=True)
        return _Graph(found // k, found % k, np.bincount(back, self.weight), np.bincount(label, self.mass, minlength=k), self.scale)


def _renumbered(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1]


def _move(g: _Graph, label: np.ndarray, resolution: float, rng) -> tuple[np.ndarray, bool]:
    """Each node to the neighbouring or an empty community of largest gain, again for the neighbours of what moved, until none gains."""
    at, mass, members = label.tolist(), np.bincount(label, g.mass, minlength=g.n).tolist(), np.bincount(label, minlength=g.n).tolist()
    empty = [c for c, k in enumerate(members) if not k]
    queue, waiting, moved = deque(rng.permutation(g.n).tolist()), [True] * g.n, False
    by = resolution / g.scale
    while queue:
        v = queue.popleft()
        waiting[v] = False
        own, d = at[v], float(g.mass[v])
        links: dict[int, float] = {own: 0.0}
        to, w = g.near(v)
        for u, x in zip(to, w):
            links[at[u]] = links.get(at[u], 0.0) + x
        mass[own] -= d
        best, gain = own, links[own] - by * d * mass[own]
        for c, x in links.items():
            now = x - by * d * mass[c]
            if now > gain + 1e-12:
                best, gain = c, now
        if gain < -1e-12 and members[own] > 1 and empty:
            best = empty.pop()
        mass[best] += d
        if best != own:
            at[v], moved = best, True
            members[own] -= 1
            members[best] += 1
            if not members[own]:
                empty.append(own)
            for u in to:
                if not waiting[u] and at[u] != best:
                    waiting[u] = True
                    queue.append(u)
    return np.array(at), moved


def _refine(g: _Graph, label: np.ndarray, resolution: float, rng, beta: float) -> np.ndarray:
    """Communities inside the communities: lone nodes join one they gain from, drawn by exp(gain / beta), so each stays connected."""
    at, mass, size = list(range(g.n)), g.mass.astype(float).tolist(), [1] * g.n
    home, by = label.tolist(), resolution / g.scale
    for v in rng.permutation(g.n).tolist():
        if size[at[v]] > 1:
            continue
        links: dict[int, float] = {}
        to, w = g.near(v)
        for u, x in zip(to, w):
            if home[u] == home[v] and at[u] != at[v]:
                links[at[u]] = links.get(at[u], 0.0) + x
        d = float(g.mass[v])
        gains = [(c, x - by * d * mass[c]) for c, x in links.items()]
        gains = [(c, x) for c, x in gains if x > 1e-12]
        if not gains:
            continue
        top = max(x for _, x in gains)
        p = np.exp(np.array([(x - top) / max(beta * max(top, 1e-12), 1e-300) for _, x in gains]))
        to = gains[int(rng.choice(len(gains), p=p / p.sum()))][0]
        old = at[v]
        mass[old] -= d
        size[old] -= 1
        mass[to] += d
        size[to] += 1
        at[v] = to
    return _renumbered(np.array(at))


def leiden(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, mass: np.ndarray, scale: float, label: np.ndarray, resolution: float = 1.0, iterations: int = 3, seed: int = 0, beta: float = 0.01) -> np.ndarray:
    """Labels of the nodes 0 .. n - 1 of a symmetric graph, from given ones."""
    rng = np.random.default_rng(seed)
    start = _Graph(src, dst, weight, mass, scale)
    for _ in range(iterations):
        g, inner, now, changed = start, np.arange(start.n), _renumbered(label), False
        while True:
            now, moved = _move(g, now, resolution, rng)
            now, changed = _renumbered(now), changed or moved
            if now.max(initial=-1) + 1 == g.n:
                break
            fine = _refine(g, now, resolution, rng, beta)
            if fine.max(initial=-1) + 1 == g.n:
                fine = now  # nothing to refine: contract the communities
            home = np.zeros(fine.max(initial=-1) + 1, int)
            home[fine] = now
            g, inner, now = g.contracted(fine), fine[inner], home
        label = now[inner]
        if not changed:
            break
    return label


def cluster_network(g: DataFrame, resolution: float = 1.0, objective: str = "modularity", initial: DataFrame | None = None, iterations: int = 3, seed: int = 0, beta: float = 0.01, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, label): Leiden communities of a symmetric graph, named by their smallest node; nodes of (node, label) ``initial`` start there."""
    if objective not in ("modularity", "CPM"):
        raise ValueError(f"unknown objective {objective!r}")
    wrong = F.isnan("weight") | (F.abs("weight") == float("inf")) | (F.col("weight") < 0)
    e = cut(g.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight"), F.max(wrong).alias("wrong")))  # the graph is computed once
    if e.where("wrong").limit(1).count():
        raise ValueError("weights are finite and not negative")
    e = e.drop("wrong")
    every = nodes(e)
    if e.count() > most_edges:
        at = cluster(e, resolution, objective, enough=most_edges)
    elif initial is not None:
        named = initial.groupBy("node").agg(F.min("label").alias("l")).join(every, "node", "left_semi")
        firsts = named.withColumn("to", F.min("node").over(Window.partitionBy("l"))).select("node", "to")
        at = every.join(firsts, "node", "left").select("node", F.coalesce("to", "node").alias("label"))
    else:
        at = every.select("node", F.col("node").alias("label"))
    at = cut(at)
    by = "node"
    if e.count() > most_edges:
        by = "label"  # what is gathered are the communities found so far
        a, b = at.select(F.col("node").alias("src"), F.col("label").alias("s")), at.select(F.col("node").alias("dst"), F.col("label").alias("t"))
        sizes = at.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("size")).withColumnRenamed("label", "node")
        e = cut(e.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("weight").alias("weight")))
        if e.count() > most_edges:
            return at
        known = sizes.withColumn("label", F.col("node"))
    else:
        known = at.withColumn("size", F.lit(1.0))
    t, edges = known.orderBy("node").toArrow(), e.toArrow()
    ids, label, size = (t.column(c).to_numpy() for c in ("node", "label", "size"))
    src, dst = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("src", "dst"))
    weight = edges.column("weight").to_numpy()
    if not len(ids):
        return at
    degree = np.bincount(src, weight, minlength=len(ids))
    mass, scale = (degree, float(weight.sum()) or 1.0) if objective == "modularity" else (size.astype(float), 1.0)
    found = leiden(src, dst, weight, mass, scale, np.searchsorted(ids, label), resolution, iterations, seed, beta)
    least = np.full(found.max() + 1, len(ids))
    np.minimum.at(least, found, np.arange(len(ids)))
    named = g.sparkSession.createDataFrame(pa.table({by: ids, "to": ids[least[found]]}))
    return at.join(named, by).select("node", F.col("to").alias("label"))
