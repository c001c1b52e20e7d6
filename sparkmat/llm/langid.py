"""Language identification by averaged hashed subword embeddings.

A text's vector is the mean of the embeddings of its hashed character n-grams (1 to 4 letters, words
padded with blanks, the text's first and last too, letters lower-cased); a linear softmax over it is trained
with stochastic gradient descent in numpy. Probabilities are tempered on a held-back part of the training
rows, and ``rejected`` marks predictions under the threshold at which that part's accepted predictions reach
``precision``. A text's score depends on that text alone, never on its neighbours in a partition.

Training reads a bounded sample: for each language and each of ``per_language`` hash buckets the row of
least hash, ``PASSAGES`` passages of ``PASSAGE`` letters of it at most (cut before they reach the driver), and
the ``most_languages`` most frequent languages. Prediction reads every whole text; embeddings and weights are
folded into one table of ``BUCKETS`` x languages.

Null texts and texts without a letter give ``und`` with score 0; empty training data gives ``und`` everywhere;
invalid UTF-8 reads as replacement characters. Ties go to the language that is first by name. Every row is
predicted, repeated and null doc_ids too. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._spark import texts

BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 16, 16, 6, 0.5
#: Training rows per language at most, and languages at most (the most frequent; others are not learned).
PER_LANGUAGE, MOST_LANGUAGES = 512, 512
#: Letters of a training passage, and evenly spread passages of a training row, so long texts do not outweigh short ones.
PASSAGE, PASSAGES = 400, 8
UND = "und"
_letters: np.ndarray | None = None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float


def letter_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 0."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x40, 0x32000):
            ch = chr(c)
            if ch.isalpha():
                t[c] = ord(ch.lower()[0])
        _letters = t
    return _letters


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and each text's offsets in them; invalid bytes become U+FFFD."""
    try:
        text = data.tobytes().decode("utf-8")
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=total[1:])
        edges = total[offsets]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        text, edges = "".join(parts), np.cumsum([0, *map(len, parts)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), edges


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all orders (one row each), validity, and each text's offsets in them.

    A blank stands before every text and after the last, so each text is padded at both ends; as no n-gram
    has a blank inside, none crosses texts.
    """
    points, edges = _points(data, offsets)
    edges = edges + np.arange(len(edges))
    n = int(edges[-1])
    padded = np.zeros(n + 4, np.uint32)
    inner = np.ones(n, bool)
    inner[edges[:-1]] = False
    padded[:n][inner] = letter_table()[points]
    buckets = np.zeros((4, n), np.uint32)
    valid = np.zeros((4, n), bool)
    h = np.zeros(n, np.uint32)
    alive = np.ones(n, bool)
    for k in range(4):
        c = padded[k : k + n]
        if k > 1:  # a blank may begin or end an n-gram, not stand inside
            alive = alive & (padded[k - 1 : k - 1 + n] > 0)
        h = (h + c + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        buckets[k] = (h * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F)) >> np.uint32(16)
        valid[k] = alive & ((c > 0) if k == 0 else (c > 0) | (padded[k - 1 : k - 1 + n] > 0))
    return buckets, valid, edges


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its class scores and whether it has a letter."""
    n, classes = len(offsets) - 1, len(model.languages)
    buckets, valid, edges = features(data, offsets)
    sums, count, at = np.zeros((n, classes)), np.zeros(n), edges[:-1]
    for k in range(4):
        count += np.add.reduceat(valid[k].astype(np.int32), at)
        for c in range(classes):
            column = model.table[c].take(buckets[k])
            column *= valid[k]
            sums[:, c] += np.add.reduceat(column, at, dtype=np.float64)
    has = np.add.reduceat(valid[0].astype(np.int32), at) > 0
    return sums / np.maximum(count, 1)[:, None] + model.bias, has


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> list[tuple[list[str], str]]:
    """(passages, lang) of at most ``per_language`` rows of each language; by hash, so the same for any partitioning."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    named = docs.where("lang is not null and text is not null")
    top = [r.lang for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    picked = named.where(F.col("lang").isin(top)).groupBy("lang", F.pmod(h, F.lit(per_language)).alias("b")).agg(F.min(h).alias("h")).select("lang", "h")
    parts = F.greatest(F.ceil(F.length("text") / PASSAGE), F.lit(1)).cast("int")
    chosen = F.transform(F.sequence(F.lit(0), F.least(parts, F.lit(PASSAGES)) - 1), lambda i: F.when(parts <= PASSAGES, i).otherwise(F.floor(i * parts / PASSAGES).cast("int")))
    cut = F.transform(chosen, lambda i: F.substring("text", i * PASSAGE + 1, F.lit(PASSAGE)))
    rows = named.select("lang", h.alias("h"), cut.alias("parts")).join(F.broadcast(picked), ["lang", "h"], "left_semi")
    return [(list(r.parts), r.lang) for r in rows.groupBy("lang", "h").agg(F.min("parts").alias("parts")).orderBy("h", "lang").collect()]


def train(rows: list[tuple[list[str], str]], precision: float = 0.995, seed: int = 7) -> Model:
    languages = sorted({lang for _, lang in rows})
    classes = len(languages)
    rng = np.random.default_rng(seed)
    if not classes:
        return Model([UND], np.zeros((1, BUCKETS), np.float32), np.zeros(1), 1.0, 1.0)
    examples, labels, held = [], [], []
    for i, (parts, lang) in enumerate(rows):
        for part in parts:
            buckets, valid, _ = features(*X.column_buffers(pa.array([part])))
            bag = buckets[valid]
            if len(bag):
                examples.append(np.unique(bag, return_counts=True))
                labels.append(languages.index(lang))
                held.append(i % 5 == 0)
    labels, held = np.array(labels), np.array(held)
    embeddings = (rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(labels))
    share = len(learn) / (classes * np.maximum(np.bincount(labels[learn], minlength=classes), 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            b, c = examples[i]
            w = (c / c.sum()).astype(np.float32)
            v = w @ embeddings[b]
            z = v @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= min(3.0, share[labels[i]])
            g = weights @ p
            weights -= rate * np.outer(v, p)
            bias -= 0.1 * rate * p
            embeddings[b] -= (rate * 20) * w[:, None] * g
    table = (embeddings @ weights).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else learn
    z = np.stack([(examples[i][1] / examples[i][1].sum()) @ table[examples[i][0]] for i in test]) + bias if len(test) else np.zeros((0, classes))
    grid = np.geomspace(0.02, 10, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(test)), labels[test]] + 1e-12).mean() if len(test) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature) if len(test) else np.zeros((0, classes))
    right, top = p.argmax(1) == labels[test] if len(test) else np.zeros(0, bool), p.max(1) if len(test) else np.zeros(0)
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    threshold = float(top[order][np.flatnonzero(good).max()]) if good.any() else 1.0
    return Model(languages, np.ascontiguousarray(table.T), bias.astype(float), temperature, min(threshold, 1 - 1e-9))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (tempered probability), rejected, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            lang, score = [np.zeros(0, object)], [np.zeros(0)]
            for _, _, data, offsets in X.blocks(batch.column(1), 1 << 19):
                z, has = logits(m, data, offsets)
                p = softmax(z / m.temperature)
                lang.append(np.where(has, names[p.argmax(1)], UND))
                score.append(np.where(has & (names[p.argmax(1)] != UND), p.max(1), 0.0))
            lang, score = np.concatenate(lang), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(score < m.threshold)], ["doc_id", "lang_pred", "score", "rejected"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    return predict(docs, train(training_rows(training)))
