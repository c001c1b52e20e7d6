"""Substring deduplication by seed and extend.

Of every window of ``WINDOW`` words the anchor is its 5-gram of least hash (the last one on ties), so equal windows
have equal anchors at equal places. A seed is an anchor with ``SIDE`` words on one side: the left ones for windows
that reach so far to the left, else the right ones, which those windows hold as well. So equal windows share a seed;
consecutive windows with one seed make one row, with a hash of all their words (its span).

1. Within a block of texts equal rows meet first; those that are not the first are repeats for certain.
2. The others join on their seed. A seed that occurs once is dropped. An occurrence with the span of the seed's first
   occurrence (smallest document and place) matches it over all its windows and is a repeat.
3. The others are extended: their words left and right of the seed are held against those of the first occurrence,
   one word after another by hashes of 0, 1, 2, ... words, and the windows inside the match are one maximal repeat.
4. Windows that reach beyond that match can only repeat one another. They meet by seed, place in the window and
   hashes of the words on both sides; all but the first of equal ones are repeats.

Repeats that touch or overlap form the maximal repeated passages, and their words are removed. Every step
aggregates before it shuffles or joins on a unique side, so a passage that a third of the documents share
costs a row per block, not a pair per occurrence.

Null, empty and short texts keep all their words (``kept_sha256`` of no words is that of the empty string), as do rows
without a doc_id, which have no place in the order. Rows that repeat a doc_id and its text are the same document and
get the same result; different texts under one doc_id are documents of their own, in the order of a hash of the text.
Bytes that are no UTF-8 are words like others, and read as replacement characters in texts that lose words. An empty
table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._spark import bounded, stage, texts, unstage

WINDOW, GRAM, SIDE = 20, 5, 8
_STEPS = WINDOW - GRAM + 1  # 5-grams in a window
#: A repeat is a long: position * SLOT + number of windows from there on.
SLOT = 32
#: A row's place is a long: (position * _OFFSETS + the anchor's place in the first window) * SLOT + number of windows.
_OFFSETS = 16


def span_words_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the words [start, end) of each span (spans may overlap)."""
    n = len(h)
    up, down = X._pow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(X.mix(h ^ np.uint64(seed)) * up[:n], out=total[1:])
    return X.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row: seed hash, span hash, first window's word index in the block, the anchor's place in it, number of windows."""
    windows = X.ngram_starts(first, WINDOW)
    if not windows.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = X.ngram_hash(h, GRAM)
    place = np.arange(len(value))
    width = 1
    for step in (1, 2, 4, 8):  # least of 2, 4, 8, 16 consecutive 5-grams, the last on ties
        right = value[step:] <= value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    assert width == _STEPS
    at = np.flatnonzero(windows)
    anchor = place[at]
    left = anchor - at >= SIDE
    edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (left[1:] != left[:-1])))
    count = np.diff(np.append(edge, len(at)))
    start = at[edge]
    offset = anchor[edge] - start
    spans = span_words_hash(h, start, start + count - 1 + WINDOW, 0x51ED270B0B4C1F5D)
    return _core_hash(h, *core(start, offset)), X.mix(spans + offset.astype(np.uint64)), start, offset, count


def core(start: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each row's seed, the word after it, and whether the seed has the words left of the anchor."""
    left, anchor = offset >= SIDE, start + offset
    return anchor - np.where(left, SIDE, 0), anchor + GRAM + np.where(left, 0, SIDE), left


def _core_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
    return X.mix(span_words_hash(h, begin, end, 0x2F0B4C1F5D51ED27) + left.astype(np.uint64))


def first_in_block(doc: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrence of each key, and of the later ones, by (doc, at)."""
    order = np.lexsort((at, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = (doc[order] != doc[head]) | (at[order] != at[head])
    return order[~later], order[later]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, which orders its documents: the doc_id, or a number if one doc_id has different texts."""
    own = docs.withColumn("_key", F.col("doc_id").cast("long"))
    digest = F.xxhash64(F.col("text").cast("string"))
    ids = own.where("_key is not null").select("_key", digest.alias("h"))
    if not ids.groupBy("_key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").limit(1).count():
        return own
    # Places of the different (doc_id, text) in their order: ranges are sorted apart, and offset by the sizes before them.
    ranged = ids.distinct().repartitionByRange("_key", "h").sortWithinPartitions("_key", "h")
    placed = stage(ranged.select("_key", "h", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "ids")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("p").count().collect()):  # a row a partition
        offsets.append((r["p"], before))
        before += r["count"]
    places = placed.join(F.broadcast(docs.sparkSession.createDataFrame(offsets, "p int, o long")), "p").select(F.col("_key").alias("_id"), F.col("h").alias("_h"), (F.col("i") + F.col("o")).alias("_place"))
    return own.join(places, (F.col("_key") == F.col("_id")) & (digest == F.col("_h")), "left").withColumn("_key", F.col("_place")).drop("_id", "_h", "_place")


def _seed_rows(docs: DataFrame) -> DataFrame:
    """sure (a repeat for certain), seed, span, doc, place; a sure row's seed is arbitrary, to spread them."""

    def run(batches):
        X.only()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in X.blocks(batch.column(1)):
                starts, ends, first = X.word_spans(data, offsets)
                seed, span, start, offset, count = seeds(X.span_hash(data, starts, ends), first)
                text = np.searchsorted(first, start, "right") - 1
                doc, place = ids[lo + text], ((start - first[text]) * _OFFSETS + offset) * SLOT + count
                once, later = first_in_block(doc, place, seed, span)
                order = np.concatenate([once, later])
                sure = np.arange(len(order)) >= len(once)
                seed = np.where(sure, X.mix(doc[order].astype(np.uint64) + place[order].astype(np.uint64)), seed[order])
                yield pa.RecordBatch.from_arrays([pa.array(sure), pa.array(X.signed(seed)), pa.array(X.signed(span[order])), pa.array(doc[order]), pa.array(place[order])], ["sure", "seed", "span", "doc", "place"])

    return docs.where("_key is not null").select("_key", "text").mapInArrow(run, "sure boolean, seed long, span long, doc long, place long")


def _grown(at: np.ndarray, most: np.ndarray, h: np.ndarray, side: int) -> pa.ListArray:
    """Of each word position the hashes of its 0, 1, ... ``most`` neighbours to the left (side -1) or right (1)."""
    n = most + 1
    row = np.repeat(np.arange(len(at)), n)
    width = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin, end = (at[row] - width, at[row]) if side < 0 else (at[row], at[row] + width)
    hashes = span_words_hash(h, begin, end, 0x6A09E667F3BCC908)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(X.signed(hashes)))


def _extensions(docs: DataFrame) -> DataFrame:
    """seed, doc, place, before, after: the words around each seed of a document's ``places``, as far as its windows reach."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for lo, hi, data, offsets in X.blocks(batch.column(1)):
                starts, ends, first = X.word_spans(data, offsets)
                h = X.span_hash(data, starts, ends)
                part = lists.slice(lo, hi - lo)
                places = part.flatten().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                start, offset, count = places // (SLOT * _OFFSETS) + first[text], places // SLOT % _OFFSETS, places % SLOT
                begin, end, left = core(start, offset)
                before = _grown(begin, begin - start, h, -1)
                after = _grown(end, start + count - 1 + WINDOW - end, h, 1)
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(_core_hash(h, begin, end, left))), pa.array(ids[lo + text]), pa.array(places), before, after], ["seed", "doc", "place", "before", "after"])

    return docs.select("_key", "text", "places").mapInArrow(run, "seed long, doc long, place long, before array<long>, after array<long>")


def repeats(docs: DataFrame) -> DataFrame:
    """doc (``keyed``'s _key) and run of every repeated run of windows."""
    found = _seed_rows(docs)
    known = found.where("not sure").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", F.lit(True).alias("known"))
    met = stage(found.join(known, "seed", "left").where("sure or known").select("sure", "seed", "span", "doc", "place"), "seeds")
    position, offset, count = F.floor(F.col("place") / (SLOT * _OFFSETS)), F.floor(F.col("place") / SLOT) % _OFFSETS, F.col("place") % SLOT
    run = lambda at, n: (at * SLOT + n).cast("long").alias("run")
    whole = met.where("sure").select("doc", run(position, count))
    once = met.where("not sure")
    groups = once.groupBy("seed").agg(F.min("span").alias("lo"), F.max("span").alias("hi"), F.min(F.struct("doc", "place", "span")).alias("head"))
    groups = stage(groups, "groups")  # written, so that Spark can split a seed that many documents have where it joins
    marked = stage(once.join(bounded(groups), "seed").select("doc", "place", (F.struct("doc", "place") == F.struct("head.doc", "head.place")).alias("first"), (F.col("span") == F.col("head.span")).alias("same"), (F.col("lo") < F.col("hi")).alias("open")), "marked")
    whole = stage(whole.unionByName(marked.where("same and not first").select("doc", run(position, count))), "whole")
    unstage(met, groups)
    unsettled = stage(marked.where("open and (first or not same)").groupBy("doc").agg(F.collect_list("place").alias("places")), "unsettled")
    unstage(marked)
    some = docs.select("_key", "text").join(bounded(unsettled.select(F.col("doc").alias("_key"))), "_key", "left_semi")
    around = stage(_extensions(some.join(unsettled.withColumnRenamed("doc", "_key"), "_key")), "around")
    unstage(unsettled)
    heads = around.groupBy("seed").agg(F.min(F.struct("doc", "place", "before", "after")).alias("head"))
    equal = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda t, v: t + v) - 1
    others = around.join(heads, "seed").where(F.struct("doc", "place") != F.struct("head.doc", "head.place"))
    # A window with o words left of the anchor lies in the match if it reaches no further than the match on both sides.
    reach, last = F.when(offset >= SIDE, F.lit(SIDE)).otherwise(0), _STEPS - 1
    low, high = offset - count + 1, offset
    right = F.when(offset >= SIDE, F.lit(0)).otherwise(SIDE)
    extended = others.select("seed", "doc", "before", "after", position.alias("at"), offset.alias("o"), low.alias("low"), reach.alias("reach"), right.alias("right"), F.greatest(low, last - right - equal("after", "head.after")).alias("from"), F.least(high, reach + equal("before", "head.before")).alias("to"))
    extended = stage(extended, "extended")
    unstage(around)
    matched = extended.where("from <= to").select("doc", run(F.col("at") + F.col("o") - F.col("to"), F.col("to") - F.col("from") + 1))
    beyond = F.filter(F.sequence(F.col("low"), F.col("o")), lambda w: (w < F.col("from")) | (w > F.col("to")))
    single = extended.withColumn("w", F.explode(beyond)).select("seed", "w", F.element_at("before", (F.col("w") - F.col("reach") + 1).cast("int")).alias("b"), F.element_at("after", (last - F.col("w") - F.col("right") + 1).cast("int")).alias("a"), "doc", (F.col("at") + F.col("o") - F.col("w")).alias("at"))
    place = F.struct("doc", "at")
    firsts = single.groupBy("seed", "w", "b", "a").agg(F.min(place).alias("head"), F.max(place).alias("last")).where("head < last").select("seed", "w", "b", "a", "head")
    later = single.join(firsts, ["seed", "w", "b", "a"]).where(place > F.col("head")).select("doc", run(F.col("at"), F.lit(1)))
    return whole.unionByName(matched).unionByName(later)


def _kept(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one blank."""
    text = X.text_of(first)[keep]
    s, e = starts[keep], ends[keep]
    more = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    mark = np.zeros(len(data) + 2, np.int8)
    np.add.at(mark, s, 1)
    np.add.at(mark, e + more, -1)
    mask = np.cumsum(mark[: len(data)], dtype=np.int8) > 0
    out = np.where(X.SPACE[data], np.uint8(0x20), data)[mask].tobytes()
    size = np.bincount(text, (e - s) + more, minlength=len(offsets) - 1).astype(np.int64)
    end = np.cumsum(size)
    return [out[b - n : b] for b, n in zip(end.tolist(), size.tolist())]


def _covered(first: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Mask of the block's words that the repeats of each text (null: none) cover."""
    cover = np.zeros(int(first[-1]) + 1, np.int64)
    if len(lists) != lists.null_count:
        places = lists.flatten().to_numpy(zero_copy_only=False)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begin = np.repeat(first[:-1], n) + places // SLOT
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + places % SLOT - 1 + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _joined(docs: DataFrame) -> DataFrame:
    """``docs`` with _runs, the repeats of each row's document (null: none)."""
    own = keyed(docs)
    lists = stage(repeats(own).groupBy("doc").agg(F.collect_list("run").alias("_runs")).withColumnRenamed("doc", "_doc"), "repeats")
    return own.join(lists, F.col("_key") == F.col("_doc"), "left").drop("_doc", "_key")


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches):
        for batch in batches:
            words, removed, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for lo, hi, data, offsets in X.blocks(batch.column(1)):
                starts, ends, first = X.word_spans(data, offsets)
                gone = _covered(first, batch.column(2).slice(lo, hi - lo))
                hashes += [hashlib.sha256(x).hexdigest() for x in _kept(data, offsets, first, starts, ends, ~gone)]
                words.append(np.diff(first))
                total = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                removed.append(np.diff(total[first]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(np.concatenate(removed)), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(texts(docs)).select("doc_id", "text", "_runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``; texts without repeats stay as they are."""

    @F.arrow_udf("string")
    def without(text: pa.Array, runs: pa.Array) -> pa.Array:
        new: list[str] = []
        for lo, hi, data, offsets in X.blocks(text):
            starts, ends, first = X.word_spans(data, offsets)
            new += [k.decode("utf-8", "replace") for k in _kept(data, offsets, first, starts, ends, ~_covered(first, runs.slice(lo, hi - lo)))]
        return pa.array(new, pa.string())

    # Only rows that lose words go to a worker with their text.
    some = F.col("_runs").isNotNull()
    new = F.when(some, without(F.when(some, F.col("text").cast("string")), "_runs")).otherwise(F.col("text"))
    return _joined(docs).select(*(new.alias(c) if c == "text" else F.col(c) for c in docs.columns))
