"""The fertility bands reject junk that passes the base rule, and few clean documents."""

import pytest

pytest.importorskip("sparkmat.llm")
from sparkmat.llm import quality  # noqa: E402


def kind(text):
    w = text.split()
    if sum(x == "|" for x in w) > 0.3 * len(w):
        return "table"
    return "stutter" if sum(a == b for a, b in zip(w, w[1:])) > 0.5 * len(w) else "clean"


def test_bands_reject_tables_and_stutter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verdict = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    kept = {"table": [], "stutter": [], "clean": []}
    for r in docs.collect():
        if not verdict[r.doc_id].base_failed:
            kept[kind(r.text)].append(verdict[r.doc_id].kept)
    junk = kept["table"] + kept["stutter"]
    assert len(junk) >= 20 and sum(junk) <= 0.3 * len(junk)
    assert sum(kept["clean"]) >= 0.99 * len(kept["clean"])
    bands = quality.fit_bands(quality.quality_rules(docs))
    assert set(bands) == set(quality.BANDS) and bands["latin"].floor
