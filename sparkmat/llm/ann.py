"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors with equal components collapse first; a class keeps its ``k`` + 1 smallest ids, which is all that
ties to smaller ids can ask for. Classes are dealt to shards by their length, by the band of their norm
(``BAND`` octaves, so no vector of a shard vanishes beside another) and by hash. A shard's graph is built in
batches: greedy searches in the graph so far propose neighbours, relaxed distance pruning (factor ``alpha``)
keeps diverse ones, and backward edges are pruned alike. Queries beam-search every shard of their length, and
each task keeps its best, so ``shards`` x ``k`` candidates per query meet at the end. For the graph, largest
inner product becomes least Euclidean distance by one more component, sqrt(largest squared norm - squared
norm), after an exact scaling by a power of two; scores are exact, in double precision, on the original vectors.

A shard holds ``SHARD_BYTES`` of vectors and meets queries in blocks of as many bytes: what is sent is one
shard and one block for each shard x block searches.

A product beyond the range of doubles is infinite and ties with its like.
Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor rows without a
vec_id. Vectors of different lengths have no inner product and never meet. Ties go to the smaller vec_id. Rows
that repeat a vec_id and its vector are one row; a query whose vec_id has several vectors asks with the least of
them (by component), a candidate with several scores its best. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmat.llm._spark import bounded, stage, unstage

DEGREE, BEAM, BUILD_BEAM, ALPHA = 32, 128, 64, 1.2
#: Bytes of vectors (doubles) aimed at in a shard and in a block of queries.
SHARD_BYTES = 16 << 20
#: Octaves of the norms in one shard.
BAND = 4
_SCHEMA = "query_id long, vec_id long, score double"


class Graph:
    """A robust-pruned graph over the rows of ``x`` (float32, already augmented)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3):
        self.x, self.degree, n = x, degree, len(x)
        self.sq = np.einsum("ij,ij->i", x, x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(np.argmin(((x - x.mean(0)) ** 2).sum(1))) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]) if n else order
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            self._insert(batch, order[max(0, done - 1) :], beam, alpha)
            done += len(batch)
            size = min(1024, max(size, done // 2))

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of query rows ``q`` (b, d) to ``ids`` (b, m); missing ids (-1) are infinitely far."""
        d = self.sq[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        d[ids < 0] = np.inf
        return d

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest that a greedy beam search finds, nearest first (ids, squared distances - |q|^2)."""
        b = len(q)
        ids = np.full((b, beam), -1, np.int32)
        ids[:, 0] = self.start
        dist = np.full((b, beam), np.inf, np.float32)
        dist[:, 0] = self._distance(q, ids[:, :1])[:, 0]
        opened = np.zeros((b, beam), bool)
        active = np.arange(b)
        while len(active):
            open_dist = np.where(opened[active] | (ids[active] < 0), np.inf, dist[active])
            best = np.argpartition(open_dist, min(1, beam - 1), axis=1)[:, :2]
            some = np.isfinite(np.take_along_axis(open_dist, best, 1))
            go = some.any(1)
            active, best, some = active[go], best[go], some[go]
            if not len(active):
                break
            rows = active[:, None]
            opened[rows, best] |= some
            near = np.where(some[:, :, None], self.edges[np.where(some, ids[rows, best], 0)], -1).reshape(len(active), -1)
            both = np.concatenate([ids[active], near], 1)
            d = np.concatenate([dist[active], self._distance(q[active], near)], 1)
            flag = np.concatenate([opened[active], np.zeros(near.shape, bool)], 1)
            # Drop what is there already: sort by id with the beam first, and blank repeats.
            order = np.argsort(both, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(both, order, 1)
            again = np.zeros(both.shape, bool)
            np.put_along_axis(again, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
            d[again] = np.inf
            top = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)
            dist[active] = np.take_along_axis(d, top, 1)
            ids[active] = np.where(np.isfinite(dist[active]), np.take_along_axis(both, top, 1), -1)
            opened[active] = np.take_along_axis(flag, top, 1)
        return ids, dist

    def prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and drops those it is ``alpha`` times nearer to, in turn."""
        p, m = candidates.shape
        candidates = np.where(candidates == points[:, None], -1, candidates)
        order = np.argsort(candidates, axis=1, kind="stable")
        s = np.take_along_axis(candidates, order, 1)
        again = np.zeros(candidates.shape, bool)
        np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        candidates = np.where(again, -1, candidates)
        d = self._distance(self.x[points], candidates) + self.sq[points][:, None]
        order = np.argsort(d, axis=1, kind="stable")
        d, candidates = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1)
        v = self.x[candidates]
        among = self.sq[candidates][:, :, None] + self.sq[candidates][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = candidates >= 0
        out = np.full((p, self.degree), -1, np.int32)
        rows = np.arange(p)
        for k in range(self.degree):
            pick = alive.argmax(1)
            has = alive[rows, pick]
            if not has.any():
                break
            out[:, k] = np.where(has, candidates[rows, pick], -1)
            alive &= ~(has[:, None] & (alpha * alpha * among[rows, pick] <= d))
            alive[rows, pick] = False
        return out

    def _insert(self, batch: np.ndarray, rest: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.search(self.x[batch], beam)
        peers = np.random.default_rng(int(batch[0])).choice(batch, (len(batch), min(len(batch), 4)))  # links inside the batch
        for i in range(0, len(batch), 256):
            part = slice(i, i + 256)
            self.edges[batch[part]] = self.prune(batch[part], np.concatenate([found[part], peers[part].astype(np.int32)], 1), alpha)
        out = self.edges[batch]
        source, target = np.repeat(batch, self.degree), out.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        free = (self.edges[nodes] < 0).sum(1)
        width = 2 * self.degree
        for i in range(0, len(nodes), 256):
            part = slice(i, i + 256)
            own, n, c = nodes[part], len(nodes[part]), count[part]
            extra = np.full((n, int(c.max())), -1, np.int32)
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[np.repeat(np.arange(n), c), at] = source[first[part][0] : first[part][0] + c.sum()]
            fits = c <= free[part]
            for j in np.flatnonzero(fits):
                row = self.edges[own[j]]
                row[np.flatnonzero(row < 0)[: c[j]]] = extra[j, : c[j]]
            full = np.flatnonzero(~fits)
            if len(full):
                nearest = extra[full]
                if nearest.shape[1] > width:
                    d = self._distance(self.x[own[full]], nearest)
                    nearest = np.take_along_axis(nearest, np.argpartition(d, width - 1, axis=1)[:, :width], 1)
                self.edges[own[full]] = self.prune(own[full], np.concatenate([self.edges[own[full]], nearest], 1), alpha)


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) and band (of the norm) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))
    # By the largest component first: squares of large or small ones leave the range of doubles.
    rows = rows.withColumn("peak", F.array_max(F.transform("v", F.abs)))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak")))
    return rows.select("vec_id", "v", F.floor((F.log2("peak") + F.log2(squares) / 2) / BAND).cast("int").alias("band"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """members (the k + 1 smallest ids of equal vectors, ascending) and v; pre-aggregated, so a hot vector is cheap.

    Bounded lists: ids are ranked within (vector hash, id bucket) first, so no list ever holds more than (k + 1) per bucket.
    """
    hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v")).withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    near = Window.partitionBy("h1", "h2", "bucket").orderBy("vec_id")
    few = hashed.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lists = few.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("members"))
    head = hashed.join(lists.select("h1", "h2", "members", F.col("members")[0].alias("vec_id")), ["h1", "h2", "vec_id"])
    return head.dropDuplicates(["h1", "h2"]).select("members", "v", "h1", "band", F.size("v").alias("dim"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scaled(v: np.ndarray, band: int) -> np.ndarray:
    """Norms under 1, exactly (but for components that vanish beside the largest)."""
    return np.ldexp(v, -BAND * (band + 1))


def _augmented(v: np.ndarray) -> np.ndarray:
    norm = np.einsum("ij,ij->i", v, v)
    return np.concatenate([v, np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))[:, None]], 1).astype(np.float32)


def _build(key, part):
    part = part.combine_chunks()
    members = part.column("members").to_pylist()
    order = np.argsort(np.array([m[0] for m in members]))
    v = _matrix(part.column("v").combine_chunks())[order]
    g = Graph(_augmented(_scaled(v, key[1].as_py())))
    ids = [members[i] for i in order]
    return pa.table({
        **{name: pa.array([k.as_py()], pa.int32()) for name, k in zip(("dim", "band", "shard"), key)},
        "start": pa.array([g.start], pa.int32()),
        "v": pa.array([np.ascontiguousarray(v).tobytes()]),
        "edges": pa.array([g.edges.tobytes()]),
        "members": pa.array([[m for own in ids for m in own]], pa.list_(pa.int64())),
        "sizes": pa.array([list(map(len, ids))], pa.list_(pa.int32())),
    })


def _look(k: int, beam: int):
    def run(key, left, right):
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            one = {c: right.column(c)[0] for c in right.column_names}
            edges = np.frombuffer(one["edges"].as_buffer(), np.int32).reshape(-1, DEGREE)
            v = np.frombuffer(one["v"].as_buffer(), np.float64).reshape(len(edges), -1)
            members, sizes = np.array(one["members"].as_py(), np.int64), np.array(one["sizes"].as_py(), np.int64)
            begin = np.cumsum(sizes) - sizes
            g = Graph.__new__(Graph)
            g.x, g.edges, g.degree, g.start = _scaled(v, one["band"].as_py()).astype(np.float32), edges, DEGREE, one["start"].as_py()
            g.sq = np.zeros(len(v), np.float32)  # augmented vectors have one norm, so inner products rank alone
            left = left.combine_chunks()
            ids, q, bands = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks()), left.column("query_band").to_numpy()
            for i in range(0, len(ids), 512):
                qs = q[i : i + 512]
                small = np.concatenate([_scaled(x[None], int(n)) for x, n in zip(qs, bands[i : i + 512])]).astype(np.float32)
                found, _ = g.search(small, max(beam, k + 1))
                for own, x, f in zip(ids[i : i + 512].tolist(), qs, found):
                    f = f[f >= 0]
                    score = np.array([float(np.dot(x, v[j])) for j in f])
                    s = score[np.repeat(np.arange(len(f)), sizes[f])]
                    name = np.concatenate([members[begin[j] : begin[j] + sizes[j]] for j in f])
                    s, name = s[name != own], name[name != own]
                    best = np.lexsort((name, -s))
                    best = best[np.sort(np.unique(name[best], return_index=True)[1])][:k]
                    out[0] += [own] * len(best)
                    out[1] += name[best].tolist()
                    out[2] += s[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def search(table: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row (its own vec_id excluded).

    ``shard_rows``, where given, bounds shards and blocks in place of ``SHARD_BYTES``.
    """
    rows = stage(usable(table), "vectors")
    index = stage(classes(rows, k), "classes")
    unstage(rows)
    parts = lambda n: F.ceil(n / shard_rows if shard_rows else n * F.col("dim") * 8 / SHARD_BYTES).cast("int")
    plan = stage(index.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).select("dim", "band", parts(F.col("n")).alias("shards")), "shards")
    dealt = index.join(bounded(plan), ["dim", "band"]).withColumn("shard", F.pmod("h1", "shards").cast("int"))
    total = plan.agg(F.sum("shards")).first()[0] or 1
    # As many partitions as there is work to deal: a shard is few bytes and much work, so small partitions are not merged.
    apart = lambda df, n, *keys: df.repartition(min(2 * n, 100_000), *keys)
    graphs = stage(apart(dealt.select("dim", "band", "shard", "members", "v"), total, "dim", "band", "shard").groupBy("dim", "band", "shard").applyInArrow(_build, "dim int, band int, shard int, start int, v binary, edges binary, members array<long>, sizes array<int>"), "graphs")
    least = usable(queries).groupBy("vec_id").agg(F.min(F.struct("v", "band")).alias("q"))
    asked = stage(least.select("vec_id", "q.v", F.col("q.band").alias("query_band"), F.size("q.v").alias("dim")), "queries")
    unstage(index)
    blocks = stage(asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", parts(F.col("n")).alias("blocks")), "blocks")
    meet = plan.join(bounded(blocks), "dim")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    pairs = asked.join(bounded(stage(meet, "meet")), "dim").select("vec_id", "v", "query_band", "dim", "band", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    shards = graphs.join(bounded(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = "dim", "band", "shard", "block"
    groups = plan.join(blocks, "dim").agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    near = apart(pairs, groups, *by).groupBy(*by).cogroup(apart(shards, groups, *by).groupBy(*by)).applyInArrow(_look(k, beam), _SCHEMA)
    best = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
