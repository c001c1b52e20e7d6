"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus' most frequent pre-token lengths: every task keeps a bounded
summary of its heaviest pre-tokens, and at most ``table_size`` of them (a fixed bound, about 10 bytes each) are
encoded once on the driver and broadcast. What misses it is encoded through a bounded cache in the worker.

Texts are never shuffled, nor are their pre-tokens. What is exchanged is the summaries: ``PER_TASK`` rows of a piece and
its count from each task of the first pass, whatever the task read, summed by piece. That first pass reads all
texts once more than the count itself does.

Null and empty texts count 0 bytes and 0 tokens; invalid UTF-8 counts as replacement characters; repeated rows and
rows without a doc_id are counted each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._spark import texts
from sparkmat.llm._tokens import cache

TABLE_SIZE = 1 << 16
PER_TASK = 1 << 12
KEEP = 1 << 16


def frequent_spans(docs: DataFrame, model: str, table_size: int = TABLE_SIZE) -> list:
    """The pre-tokens that are heaviest in the tasks' summaries, over all rows: [(piece, is_first)]."""

    def heavy(batches):
        coder = cache(model).coder
        keys, counts, shown = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for batch in batches:
            for _, _, data, offsets in X.blocks(batch.column(0)):
                starts, ends = coder.spans(data, offsets)
                ok = ends - starts <= 64
                starts, ends = starts[ok], ends[ok]
                begins = np.isin(starts, offsets)
                h = X.span_hash(data, starts, ends)
                h, starts, ends = h[~begins], starts[~begins], ends[~begins]
                u, i, c = np.unique(h, return_index=True, return_counts=True)
                known = np.isin(u, keys, assume_unique=True)
                for k, s, e in zip(u[~known].tolist(), starts[i[~known]].tolist(), ends[i[~known]].tolist()):
                    shown[k] = data[s:e].tobytes()
                keys, back = np.unique(np.concatenate([keys, u]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
                if len(keys) > KEEP:
                    top = np.sort(np.argpartition(counts, -KEEP // 2)[-KEEP // 2 :])
                    keys, counts = keys[top], counts[top]
                    shown = {k: shown[k] for k in keys.tolist()}
        top = np.lexsort((keys, -counts))[:PER_TASK]
        yield pa.RecordBatch.from_arrays([pa.array([shown[k] for k in keys[top].tolist()], pa.binary()), pa.array(counts[top])], ["piece", "n"])

    found = texts(docs).select("text").mapInArrow(heavy, "piece binary, n long")
    return [bytes(r.piece) for r in found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).select("piece").collect()]


def build_table(pieces: list[bytes], model: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and lengths of the pieces."""
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    n = np.array([len(x) for x in cache(model).coder.encode([p.decode("utf-8", "replace") for p in pieces], [False] * len(pieces))], np.uint16)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    h = X.span_hash(data, ends - [len(p) for p in pieces], ends)
    order = np.argsort(h)
    return h[order], n[order]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every whole text."""
    spark = docs.sparkSession
    hashes, lengths = build_table(frequent_spans(docs, model, table_size), model)
    # Slots by the top bits: one probe a pre-token. A slot keeps one pre-token; the worker cache has the others.
    bits = max(1, int(table_size).bit_length() + 1)
    keys = ~(np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    size = np.zeros(1 << bits, np.uint16)
    slots = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    keys[slots], size[slots] = hashes, lengths
    table = spark.sparkContext.broadcast((keys, size))

    def count(batches):
        keys, size = table.value
        tier2 = cache(model)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, _, data, offsets in X.blocks(batch.column(1)):
                starts, ends = tier2.coder.spans(data, offsets)
                n = np.zeros(len(starts), np.int64)
                if len(starts):
                    begins = np.zeros(len(data) + 1, bool)
                    begins[offsets] = True
                    begins = begins[starts]
                    h = X.span_hash(data, starts, ends)
                    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                    hit = (keys[slot] == h) & ~begins
                    n[hit] = size[slot[hit]]
                    rest = np.flatnonzero(~hit)
                    n[rest] = tier2.lookup(data, starts[rest], ends[rest], begins[rest])[1]
                done = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=done[1:])
                n_tokens.append(np.diff(done[np.searchsorted(starts, offsets)]))
                n_bytes.append(np.diff(offsets))
            if n_tokens:
                b, t = np.concatenate(n_bytes), np.concatenate(n_tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b), pa.array(t), pa.array(t > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
