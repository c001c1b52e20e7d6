"""Mixture-controlled packing by deficit round-robin.

Rows are first dealt over tasks in turns and put in the order of a hash, so every task reads each source in
proportion however the table is laid out. Documents queue by source, and every window (one sequence of
``size`` ids) grants each source its target share of the window on top of the deficit it still has; sources
are served in turn, up to their deficits and in pieces of ``least`` ids or more, and what a source is still
owed goes to the next window. If no source with documents is owed anything, the one owed most (or ahead
least) fills the rest: windows are always full. What is left of a task's documents (less than a window) goes
to a second packing over ``FAN_IN`` tasks, which starts from what those tasks owe together; so there is at
most one padded sequence per ``FAN_IN`` tasks.

A deficit is the source's share of all windows so far less what it was served. Shares travel with the rows,
and a task holds queues of sources with documents waiting only, so the number of sources is not limited.

Targets default to the sources' shares of the bytes of all rows, since every document is packed whole;
other targets hold for as long as the sources last. Null and empty texts are the end id alone; a null
source is the source ''. Repeated rows, and rows without a doc_id, are packed each; an empty table gives no piece.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._spark import bounded, stage
from sparkmat.llm._tokens import cache

SIZE, LEAST, LOOK_AHEAD, FAN_IN = 2048, 64, 256, 64
#: Bytes of text a task packs.
TASK_BYTES = 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_SCHEMA = PIECES + ", tail_group long, share double, served long, windows long, ids binary"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


class Packer:
    """Packs queued documents into windows; ``rows`` collects the pieces."""

    def __init__(self, targets: dict[str, float], size: int, least: int, sequence: int, served: dict[str, int] | None = None, windows: int = 0):
        self.size, self.least, self.sequence = size, least, sequence
        self.targets = dict(targets)
        self.served = dict(served or {})
        self.windows = windows
        self.queues: dict[str, deque] = {}
        self.turn = 0
        self.left = 0
        self.rows: list[list] = [[] for _ in _NAMES]

    def add(self, source: str, doc_id: int, ids: np.ndarray, start: int, total: int) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, ids, 0, start, total])
        self.left += len(ids)

    def deficit(self, source: str) -> float:
        return self.targets.get(source, 0.0) * self.size * self.windows - self.served.get(source, 0)

    def _emit(self, source: str, want: int, offset: int) -> int:
        """Take ``want`` ids at most from the head of a queue into the open window; the number taken."""
        head = self.queues[source][0]
        doc_id, ids, at, start, total = head
        n = min(want, len(ids) - at)
        part = ids[at : at + n]
        for column, v in zip(self.rows, (doc_id, start + at, n, zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset, source, None, None, None, None, None)):
            column.append(v)
        head[2] += n
        if head[2] == len(ids):
            self.queues[source].popleft()
        self.served[source] = self.served.get(source, 0) + n
        self.left -= n
        return n

    def window(self) -> None:
        """Fill one sequence (the last may be short)."""
        self.windows += 1
        order = list(self.queues)
        filled = 0
        for k in range(len(order)):
            s = order[(self.turn + k) % len(order)]
            queue = self.queues[s]
            while queue and filled < self.size:
                head, room = queue[0], self.size - filled
                owed = int(min(self.deficit(s), room))
                if owed < min(self.least, len(head[1]) - head[2], room):
                    break
                filled += self._emit(s, owed, filled)
            if filled == self.size:
                break
        self.turn = (self.turn + k + 1) % len(order)
        if filled < self.size and self.left:
            most = [(-self.deficit(s), i, s) for i, s in enumerate(order) if self.queues[s]]
            heapq.heapify(most)
            while filled < self.size and most:
                ahead, i, s = heapq.heappop(most)
                filled += self._emit(s, self.size - filled if self.left <= self.size - filled else min(self.size - filled, max(self.least, int(-ahead))), filled)
                if self.queues[s]:
                    heapq.heappush(most, (-self.deficit(s), i, s))
        for s in order:
            if not self.queues[s]:
                del self.queues[s]
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.rows, types)], _NAMES)
        self.rows = [[] for _ in _NAMES]
        return out

    def remains(self, group: int) -> pa.RecordBatch:
        """What is still queued, ids included; a row for what each source was served and one for the windows."""
        blank = (0, 0, 0, 0, 0, 0, 0)
        more = [(*blank, s, group, None, n, None, None) for s, n in self.served.items()] + [(*blank, "", group, None, None, self.windows, None)]
        for s, queue in self.queues.items():
            more += [(doc_id, start + at, len(ids) - at, 0, total, 0, 0, s, group, self.targets.get(s, 0.0), None, None, ids[at:].tobytes()) for doc_id, ids, at, start, total in queue]
        for row in more:
            for column, v in zip(self.rows, row):
                column.append(v)
        return self.batch()


def source_bytes(rows: DataFrame) -> DataFrame:
    """source, n: bytes of its texts, one more for each row."""
    return stage(rows.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("n")), "sources")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SIZE, end_id: int = 1, targets: dict[str, float] | None = None, least: int = LEAST) -> DataFrame:
    """``PIECES``: each id of each document (with the end id) in exactly one piece; offsets are gapless in a sequence."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    sizes = source_bytes(rows)
    total = sizes.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / total
    if targets is not None:
        given = docs.sparkSession.createDataFrame(list(targets.items()), "source string, target double")
        sizes, share = sizes.join(given, "source", "left"), F.coalesce("target", F.lit(0.0))
    shares = stage(sizes.select("source", share.alias("share")), "shares")
    # Turns deal the rows of any layout evenly; the order by hash mixes what a task was dealt by each input task.
    dealt = rows.join(bounded(shares), "source").repartition(-(-total // TASK_BYTES)).withColumn("salt", F.xxhash64("doc_id", "source", "text"))
    rows = dealt.sortWithinPartitions("salt", "doc_id", "source").select("doc_id", "text", "source", "share")

    def run(batches):
        ids_of, task = cache(tokenizer), TaskContext.get().partitionId()
        packer = Packer({}, size, least, task << 32)
        for batch in batches:
            names, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            packer.targets.update(zip(sources, batch.column(3).to_pylist()))
            for lo, hi, data, offsets in X.blocks(batch.column(1)):
                ids, at = ids_of.tokens(data, offsets)
                for j in range(hi - lo):
                    own = np.append(ids[at[j] : at[j + 1]], np.uint16(end_id))
                    packer.add(sources[lo + j], names[lo + j], own, 0, len(own))
                while packer.left >= (LOOK_AHEAD + 1) * size:
                    packer.window()
                if len(packer.rows[0]) > 10_000:
                    yield packer.batch()
        while packer.left >= size:
            packer.window()
            if len(packer.rows[0]) > 10_000:
                yield packer.batch()
        yield packer.batch()
        yield packer.remains(task // FAN_IN)

    def finish(key, table):
        rows = table.to_pylist()
        served = {r["source"]: r["served"] for r in rows if r["served"] is not None}
        order = sorted((r for r in rows if r["ids"]), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["start"]))
        shares = {r["source"]: r["share"] for r in order}
        packer = Packer(shares, size, least, 1 << 62 | key[0].as_py() << 32, served, sum(r["windows"] or 0 for r in rows))
        for r in order:
            packer.add(r["source"], r["doc_id"], np.frombuffer(r["ids"], np.uint16), r["start"], r["doc_tokens"])
        while packer.left:
            packer.window()
        return pa.Table.from_batches([packer.batch()]).select(_NAMES[:8])

    packed = stage(rows.mapInArrow(run, _SCHEMA), "packing")
    tails = packed.where("tail_group is not null")
    waiting = tails.where("ids is not null").select("tail_group", "source").distinct()
    served = tails.where("served is not null").groupBy("tail_group", "source").agg(F.sum("served").alias("served")).join(waiting, ["tail_group", "source"], "left_semi")
    tails = tails.where("served is null").unionByName(served, allowMissingColumns=True).groupBy("tail_group").applyInArrow(finish, PIECES)
    return packed.where("tail_group is null").select(*_NAMES[:8]).unionByName(tails)
