"""Addresses that are not written plainly, and rows whose doc_id is no key."""

import pytest

pytest.importorskip("sparkmat.llm")
from sparkmat.llm import pii  # noqa: E402

SCHEMA = "doc_id long, text string"
HIDDEN = ["ann [at] site [dot] org", "bob(at)site(dot)example(dot)net", "cat@ site.org", "dan @ site . org"]


def test_hidden_addresses_go(spark):
    plain = [f"please write to user{i}@host{i}.org about it" for i in range(60)]
    other = [f"meet user{i} @ noon{i}. Then go to name{i}@work today" for i in range(60)]
    hidden = [f"please write to {h} about it" for h in HIDDEN * 5]
    docs = spark.createDataFrame(list(enumerate(plain + other + hidden)), SCHEMA)
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(got[i] == "please write to [EMAIL] about it" for i in [*range(60), *range(120, 140)])
    assert all(got[60 + i] == t for i, t in enumerate(other))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b@c.org"), (None, "x y 10.1.2.3"), (1, "write to d@e.org"), (1, "nothing here"), (1, "ip 10.0.0.1 and d@e.org"), (2, None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "a [EMAIL]"), (0, "x y [IP]"), (1, "ip [IP] and [EMAIL]"), (1, "nothing here"), (1, "write to [EMAIL]"), (2, "")]
