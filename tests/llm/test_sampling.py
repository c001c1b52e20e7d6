"""Sampled segmentations against the full list of segmentations of short texts."""

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sparkmat.llm")
from sparkmat.llm import sampling  # noqa: E402

ALPHA = 0.5


def all_segmentations(lat, text):
    """{ids: normalised log-probability} of a short text without unknown characters."""
    sp, known = lat.sp, {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            known[sp.id_to_piece(i)] = i, -ALPHA * math.log1p(-sp.get_score(i))

    def split(t):
        if not t:
            yield (), 0.0
        for n in range(1, len(t) + 1):
            if t[:n] in known:
                i, s = known[t[:n]]
                for ids, more in split(t[n:]):
                    yield (i, *ids), s + more

    found = dict(split(sp.normalize(text)))
    total = math.log(math.fsum(map(math.exp, found.values())))
    return {ids: s - total for ids, s in found.items()}


@pytest.mark.parametrize("text", ["cat", "a  to", "hello we"])
def test_distribution(text):
    lat = sampling.lattices(sampling.MODEL, ALPHA)
    truth, n, k = all_segmentations(lat, text), 6000, 3
    assert len(truth) > k
    first, second, weight = Counter(), Counter(), 0.0
    for i, own in enumerate(sampling.sample_texts(lat, list(range(n)), [text] * n, k)):
        got = [tuple(ids.tolist()) for ids, *_ in own]
        assert len(set(got)) == k
        for ids, (_, logp, value, inclusion, _) in zip(got, own):
            assert math.isclose(logp, truth[ids], abs_tol=1e-9) and inclusion <= 0
            weight += math.exp(logp - inclusion)
        values = [x[2] for x in own]
        assert values == sorted(values, reverse=True)
        first[got[0]] += 1
        second[got[1]] += 1
    # Sampling without replacement: the second is drawn from what the first left.
    p = {ids: math.exp(s) for ids, s in truth.items()}
    for ids, x in p.items():
        y = x * math.fsum(q / (1 - q) for other, q in p.items() if other != ids)
        for seen, expect in ((first[ids], x), (second[ids], y)):
            assert abs(seen - n * expect) <= 5 * math.sqrt(n * expect * (1 - expect)) + 3
    assert abs(weight / n - 1) < 0.1  # unbiased for the sum of all probabilities


def test_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Zoë 日本 😀\t\n  end ", "x"), (4, "w" * 3000, "x"), (None, "some words", "x"), (5, "a b c " * 2000, "x"), (5, "a b c " * 2000, "x"), (6, "▁▁ a ▁b<s>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sampling.sample_digests(docs, k=4).orderBy("doc_id", "sample").collect()
    count = Counter(r.doc_id for r in got)
    assert count == {1: 1, 2: 1, 3: 4, 4: 4, None: 4, 5: 8, 6: 4}
    assert all(r.decodes for r in got) and all(r.n_tokens == 0 and r.log_prob == 0 for r in got if r.doc_id in (1, 2))
    assert len({(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 5}) == 4
    again = sampling.sample_digests(docs.repartition(1), k=4).orderBy("doc_id", "sample").collect()
    assert [(r.doc_id, r.sample, r.ids_crc32) for r in again] == [(r.doc_id, r.sample, r.ids_crc32) for r in got]
    assert sampling.sample(docs.limit(0)).count() == 0


def test_round_trip(spark):
    rows = [(1, "Plain text, twice."), (2, ""), (3, None), (4, "Zoë 日本 😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in sampling.decode(sampling.encode(docs)).collect()} == {i: t or "" for i, t in rows}
    sampled = sampling.sample(docs, k=3)
    assert {(r.doc_id, r.text) for r in sampling.decode(sampled).collect()} == {(i, t or "") for i, t in rows}
    assert np.all([r.n >= 1 for r in sampled.selectExpr("sample AS n").collect()])


def test_lattice_work(monkeypatch):
    lat = sampling.Lattices(sampling.MODEL, ALPHA)
    sp = lat.sp
    pieces = {sp.id_to_piece(i).replace(sampling.BLANK, " "): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    begins = {p[:n] for p in pieces for n in range(1, len(p))}
    words = [" international", " qxzqxzqxzqxzqxzqxz", " 日本", " Zoë😀", " the"]
    size = np.array(list(map(len, words)))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    looked, look = [], lat._entries
    monkeypatch.setattr(lat, "_entries", lambda h: looked.append(len(h)) or look(h))
    src, length, piece, _, _ = lat._arcs(points, left)
    text, want, tried = "".join(words), set(), 0
    for i, n in enumerate(left.tolist()):
        for m in range(1, n + 1):
            tried += 1
            if (found := text[i : i + m]) in pieces or m == 1:
                want.add((i, m, pieces.get(found, -1)))
            if found not in begins:
                break
    assert set(zip(src.tolist(), length.tolist(), piece.tolist())) == want and len(src) == len(want)
    assert sum(looked) == tried  # nothing is looked up behind a beginning that no piece has
    # Dropping the words keeps the room of the arrays, and results do not depend on what is kept.
    texts = ["a few wörds 日本 😀 " * 3, "more words, more " * 40, "", "international 日 trade"] * 5
    before = sampling.sample_texts(lat, list(range(20)), texts, 3)
    room = lat._cum.a
    lat.clear()
    assert lat._cum.a is room
    monkeypatch.setattr(sampling, "CACHE_STATES", 1)
    lat.clear()
    assert len(lat._cum.a) <= len(room) and lat._cum.a is not room  # more room than the cache needs is given back
    for key, own, text in zip(range(20), before, texts):
        for a, b in zip(own, sampling.sample_texts(lat, [key], [text], 3)[0], strict=True):
            assert a[0].tolist() == b[0].tolist() and a[1:] == b[1:]
