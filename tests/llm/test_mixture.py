"""Every packed window keeps the mixture, however the table is laid out and however many sources it has."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("sparkmat.llm")
from sparkmat.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def windows(df):
    out = defaultdict(Counter)
    for r in df.collect():
        out[r.sequence_id][r.source] += r.length
    return list(out.values())


def test_clustered_table_is_mixed(spark, tmp_path, monkeypatch):
    """One file a source, one source with half of all rows, several packing tasks."""
    monkeypatch.setattr(packing, "TASK_BYTES", 300_000, raising=False)
    for s, n in (("a", 300), ("b", 150), ("c", 90), ("d", 60)):
        rows = [(i * 10 + ord(s), f"{s} some words of a text " * 60, s) for i in range(n)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = windows(packing.pack(spark.read.parquet(f"{tmp_path}/docs")))
    full = [w for w in got if sum(w.values()) == 2048]
    near = [w for w in full if all(abs(w[s] / 2048 - t) <= 0.15 for s, t in (("a", 0.5), ("b", 0.25), ("c", 0.15), ("d", 0.1)))]
    assert len(full) >= 90 and len(near) >= 0.9 * len(full)


def test_more_sources_than_queues(spark):
    rows = [(i, "one two three " * 10, f"h{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows + [(3000 + i, "one two three " * 10, "big") for i in range(1000)], SCHEMA)
    of = {r.doc_id: r.source for r in docs.collect()}
    pieces = packing.pack(docs, targets={"big": 0.5}).collect()
    assert all(r.source == of[r.doc_id] for r in pieces) and {r.doc_id for r in pieces} == set(of)
    first = min(r.sequence_id for r in pieces)
    assert 924 <= sum(r.length for r in pieces if r.sequence_id == first and r.source == "big") <= 1124
