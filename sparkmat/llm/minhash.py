"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set has the distinct 5-word shingles of its lower-cased (A-Z) words. Its signature has
``CHUNKS`` x ``WIDTH`` symbols of 16 bits, each the top bits of a minimum over the set. By pigeonhole,
two signatures that differ in fewer than 2 x CHUNKS symbols agree in all but at most one symbol of some
chunk, so each chunk is indexed WIDTH times, with one symbol left out each time: every pair under that
signature distance shares a key. (At similarity 0.85 a pair misses all chunks with probability 5e-7.)

1. Equal sets collapse into a class (one representative, the smallest doc_id).
2. Under each key every member meets the smallest one; the distinct pairs are held against the signature distance
   (``most_apart``), then confirmed on the full sets, and linked classes merge (connected components). This is
   linear in the members, whatever a group's size.
3. Members of keys that still span several components are searched for links between those components:
   exact bounds on shared rare shingles leave few pairs, which go through signatures and sets as in 2.

The distance allowed is wider than the one the index guarantees: a link fails it with probability ``MISS`` at most,
far less than the index misses, so it spares confirmations and loses no link that the index finds in practice.
So no link between different texts is lost to a cap, and no group is expanded into its pairs of copies.
Null and empty texts have an empty set, link with nothing and are kept; repeated rows of one doc_id count
as one document (if their sets differ, each row has its own n_shingles, and the set of least digest links). Rows without a doc_id
cannot be named by a component: they link with nothing, their component_id is null and they are kept. An empty table
gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._graph import components
from sparkmat.llm._spark import bounded, stage, texts, unstage

SHINGLE = 5
CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Share of links whose signatures may be further apart than ``most_apart``.
MISS = 1e-9
#: Rows of a shingle that one task pairs with the rows of other components, at about.
SPLIT = 1000
_rng = np.random.Generator(np.random.PCG64(5))
_XOR = _rng.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DOC = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, text by text, and each text's offsets in them."""
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets)
    h = X.span_hash(data, starts, ends)
    words = np.diff(first)
    g, ok = X.ngram_hash(h, SHINGLE), X.ngram_starts(first, SHINGLE)
    at = np.flatnonzero(ok)
    value, text = g[at], X.text_of(first)[at]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        whole = np.array([_sequence(h[first[t] : first[t + 1]]) for t in short], np.uint64)
        value, text = np.concatenate([value, whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        value, text = value[order], text[order]
    key = X.mix(value + text.astype(np.uint64) * _DOC)
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1]) if len(key) else np.zeros(0, bool)
    keep = np.sort(order[new])
    out = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(text[keep], minlength=len(words)), out=out[1:])
    return value[keep], out


def _sequence(h: np.ndarray) -> np.uint64:
    v = np.zeros(1, np.uint64)
    for x in h:
        v = v * np.uint64(0x2545F4914F6CDD1D) + x
    return X.mix(v + np.uint64(len(h)))[0]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit symbols of each nonempty set (rows of empty sets are zero)."""
    out = np.zeros((len(offsets) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        at = offsets[:-1][some]
        buffer = np.empty_like(values)
        for j in range(SYMBOLS):
            np.bitwise_xor(values, _XOR[j], out=buffer)
            buffer *= _MUL[j]
            out[some, j] = np.minimum.reduceat(buffer, at) >> np.uint64(48)
    return out


def digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for c in (0x8BB84B93962EACC9, 0x4B33A62ED433D4A3):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(X.mix(values ^ np.uint64(c)), out=total[1:])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return out


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digests of the set), signature."""

    def run(batches):
        X.only()
        for batch in batches:
            parts = []
            for _, _, data, offsets in X.blocks(batch.column(1)):
                values, at = shingle_sets(data, offsets)
                parts.append((np.diff(at), *map(X.signed, digests(values, at)), signatures(values, at)))
            if parts:
                n, d1, d2, s = (np.concatenate(x) for x in zip(*parts))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SYMBOLS), len(s), [None, pa.py_buffer(np.ascontiguousarray(s))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), blob], ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def index_keys(s: np.ndarray) -> np.ndarray:
    """For each signature its CHUNKS x WIDTH keys: a chunk with one symbol left out."""
    s = s.astype(np.uint64).reshape(len(s), CHUNKS, WIDTH)
    out = np.empty((len(s), CHUNKS, WIDTH), np.uint64)
    for drop in range(WIDTH):
        v = np.zeros((len(s), CHUNKS), np.uint64)
        for j in range(WIDTH):
            if j != drop:
                v = v << np.uint64(16) | s[:, :, j]  # four symbols fill the 64 bits
        out[:, :, drop] = v
    tag = np.arange(CHUNKS * WIDTH, dtype=np.uint64).reshape(CHUNKS, WIDTH)
    return X.mix(X.mix(out) + tag * _DOC).reshape(len(s), -1)


def keyed(classes: DataFrame, *more: str) -> DataFrame:
    """key, rep and the named columns, for each key of each class."""
    extra = "".join(f", {c} {dict(classes.dtypes)[c]}" for c in more)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                keys = index_keys(_symbols(batch.column("signature")))
                take = pa.array(np.repeat(np.arange(n), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(keys.reshape(-1))), *(batch.column(c).take(take) for c in ("rep", *more))], ["key", "rep", *more])

    return classes.select("rep", "signature", *(c for c in more if c != "signature")).mapInArrow(run, "key long, rep long" + extra)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and its full shingle set (sorted 64-bit hashes) for the distinct ``id`` values; of several sets that of least digest."""

    def run(batches):
        for batch in batches:
            blobs, sums = [], [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for _, _, data, offsets in X.blocks(batch.column(1)):
                values, at = shingle_sets(data, offsets)
                blobs += [np.sort(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                for s, d in zip(sums, digests(values, at)):
                    s.append(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(X.signed(np.concatenate(s))) for s in sums), pa.array(blobs, pa.binary())], ["id", "d1", "d2", "shingles"])

    ids = ids.select(F.col("id").alias("doc_id"))
    found = texts(docs).join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id long, d1 long, d2 long, shingles binary")
    return found.where(F.octet_length("shingles") > 0).groupBy("id").agg(F.min(F.struct("d1", "d2", "shingles")).alias("s")).select("id", "s.shingles")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their exact sizes: shared, united."""

    def run(batches):
        for batch in batches:
            shared, united = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                n = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                shared.append(n)
                united.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], ["a", "b", "shared", "united"])

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long, united long")


def most_apart(percent: int) -> int:
    """The signature distance that pairs of similarity ``percent`` exceed with probability ``MISS`` at most."""
    p = 1 - percent / 100
    over, d = 1.0, -1
    while over > MISS and d < SYMBOLS:
        d += 1
        over -= math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
    return d


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in ``most_apart`` symbols at most."""
    limit = most_apart(percent)

    def run(batches):
        for batch in batches:
            apart = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(apart <= limit))

    left, right = classes.select(F.col("rep").alias("a"), F.col("signature").alias("x")), classes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tokens(sets: DataFrame) -> DataFrame:
    """id, n (size of the set), token: a row per shingle."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                blobs = part.column(1).to_pylist()
                n = np.array([len(b) // 8 for b in blobs])
                at = pa.array(np.repeat(np.arange(len(blobs)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(b"".join(blobs), np.int64))], ["id", "n", "token"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, n long, token long")


def _links(confirmed: DataFrame, percent: int) -> DataFrame:
    return confirmed.where(F.col("shared") * 100 >= F.col("united") * percent).select("a", "b")


def residual_pairs(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs in different components that a link could join, among the members of keys that span components.

    Exact pruning: a link needs ``percent`` of a set to be shared, so a set with too many shingles that no
    other residual set has is alone, and linked sets meet in a shingle of the rarest ``100 - percent`` parts. Removes ``members``; the pairs read the table returned with them.
    """
    own = F.coalesce("component", "rep")
    labelled = members.select("key", "rep").join(comp, members["rep"] == comp["node"], "left").select("key", "rep", own.alias("comp"))
    labelled = stage(labelled, "labelled")
    unstage(members)
    # A key of two members has no pair but the confirmed one.
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi and size > 2").select("key")
    left = stage(labelled.join(open_keys, "key", "left_semi").select(F.col("rep").alias("id"), "comp").distinct(), "residual")
    unstage(labelled)
    tokens = _tokens(sets.join(bounded(left.select("id")), "id", "left_semi"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    some = stage(tokens.join(common, "token"), "tokens")
    alive = some.groupBy("id", "n").agg(F.count(F.lit(1)).alias("known")).where(F.col("known") * 100 >= F.col("n") * percent).select("id", "known")
    # Shingles that are in one set only are rarest: they come first in the prefix, and n - known of them are absent here.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token")) + F.col("n") - F.col("known")
    prefix = some.join(alive, "id").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = stage(prefix.join(left, "id").select("token", "id", "n", "comp", "rank"), "prefix")
    unstage(some, left)
    parts = F.ceil(F.count(F.lit(1)) / SPLIT).cast("int")
    meet = stage(prefix.groupBy("token").agg(F.min("comp").alias("main"), F.max("comp").alias("hi"), parts.alias("parts")).where("main < hi").select("token", "main", "parts"), "meet")
    # The rows of a common shingle are dealt over parts; the few outside its main component go to each.
    dealt = prefix.join(bounded(meet), "token").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    apart = dealt.where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", "part", F.col("id").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("rank").alias("ar"))
    # At the first shingle that a linked pair shares, enough must follow in both: (100 + percent) * overlap >= percent * (an + n).
    rest = F.least(F.col("an") - F.col("ar"), F.col("n") - F.col("rank")) + 1
    enough = rest * (100 + percent) >= (F.col("an") + F.col("n")) * percent
    pairs = apart.join(dealt, ["token", "part"]).where("ac <> comp").where(enough)
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), prefix


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; sets link at ``percent`` hundredths of their union or more."""
    found = stage(profile(docs), "profile")
    sizes = stage(found.select("doc_id", "n_shingles"), "sizes")
    rows = found.where("n_shingles > 0 and doc_id is not null")
    some = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "signature")).alias("s")).select("doc_id", "s.*")
    some = stage(some, "documents")
    unstage(found)
    # Only sets that several documents have are looked up: no task gathers a set's copies while those sets are few.
    same = some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = stage(same, "copies")
    classed = stage(some.join(bounded(same), ["d1", "d2", "n_shingles"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "signature"), "classes")
    unstage(some)
    classes = classed.where("doc_id = rep").select("rep", "signature")
    keys = keyed(classes)
    many = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    members = stage(keys.join(many, "key"), "members")
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    ids = stage(members.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = stage(sets_of(docs, bounded(ids)), "sets")
    unstage(ids)
    links = stage(_links(confirm(near(stars, classes, percent), sets), percent), "links")
    comp = stage(components(links), "components")
    pairs, prefix = residual_pairs(members, comp, sets, percent)
    more = stage(_links(confirm(near(pairs, classes, percent), sets), percent), "links")
    unstage(prefix, sets, comp)
    comp = stage(components(links.unionByName(more)), "components")
    unstage(links, more)
    labelled = classed.select("doc_id", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sizes.join(labelled, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns."""
    gone = stage(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(bounded(gone), docs["doc_id"] == F.col("_gone"), "left_anti")
