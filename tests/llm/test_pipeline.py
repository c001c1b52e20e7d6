"""Every stage of the pipeline against brute force on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sparkmat.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sparkmat.llm import pii, quality  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
RNG = np.random.default_rng(7)
VOCAB = ["".join(RNG.choice(list("abcdefghilmnoprstu"), RNG.integers(3, 8))) for _ in range(600)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE, BASE = prose(55), prose(150)
TEXTS = [None, "", "too short", "again and again " * 20, prose(40) + " " + PASSAGE, prose(40) + "\n" + PASSAGE + "\n" + prose(30), BASE, BASE, BASE.upper(), BASE + " tail", " ".join(w if i % 40 else "zz" for i, w in enumerate(BASE.split())), prose(80) + " write to ann.lee@example.org or +1 202 555 0143 now " + prose(20), prose(2500)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i * 2, t, "en" if i % 2 else None, f"s{i % 2}" if i % 3 else None, len(t) if t else None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    kept.append(docs)
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    return folder, kept


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def words(t):
    return re.findall(WORD, t or "")


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[1][:-1])


def test_quality_rules(stages):
    _, kept = stages
    before, after = texts(kept[0]), texts(kept[1])
    failed = set()
    for i, t in before.items():
        w = words(t)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        if len(w) < 20 or 100 * len(cover) > 30 * len(w):
            failed.add(i)
    verdict = {r.doc_id for r in quality.quality_rules(kept[0]).collect() if r.kept}
    assert failed == {0, 2, 4, 6} and set(after) == verdict and not failed & set(after)
    assert all(before[i] == t for i, t in after.items()) and len(after) >= 2


def test_one_of_each_group_stays(stages):
    _, kept = stages
    before, after = texts(kept[1]), texts(kept[2])
    sets = {i: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)})(words(t.lower())) for i, t in before.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert after == {i: before[i] for i in sets if comp[i] == i} and len(after) < len(before)


def test_repeats_go(stages):
    _, kept = stages
    before, after, seen = texts(kept[2]), texts(kept[3]), set()
    assert set(before) == set(after)
    removed = 0
    for i in sorted(before):
        w = words(before[i])
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        removed += sum(gone)
        assert words(after[i]) == [x for x, g in zip(w, gone) if not g]
    assert removed >= 55 and all(r.n_chars == len(r.text) for r in kept[3].collect())


def test_personal_data_goes(stages):
    _, kept = stages
    before, after = texts(kept[3]), texts(kept[4])
    spans = {r.doc_id: sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in r.spans.split(",") if x)) for r in pii.find(kept[3]).collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        at, clean = 0, []
        for s, e in spans[i]:
            clean.append(t[at:s] if s >= at else "")
            at = max(at, e)
        clean.append(t[at:])
        rest, p = after[i], 0
        for c in clean:
            p = rest.find(c, p)
            assert p >= 0
            p += len(c)
        assert spans[i] or after[i] == t
    assert not any("ann.lee@example.org" in t or "202 555 0143" in t for t in after.values())


def test_packing_and_run(spark, stages):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    folder, kept = stages
    tok, pieces, sequences = Tokenizer.from_file(path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in kept[5].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts(kept[4]).items():
        want, at = len(tok.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == want
            at += r.length
        assert at == want
    assert not pieces and all(sum(r.length for r in rows) <= 2048 for rows in sequences.values())
    tokens = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert tokens(corpus_pipeline.run(spark, folder)) == tokens(kept[5])
