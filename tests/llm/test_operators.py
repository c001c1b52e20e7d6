"""Training-data operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sparkmat.llm")
from sparkmat.llm import ann, langid, minhash, packing, pii, quality, substring, token_counts, warc  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
RNG = np.random.default_rng(1)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE = prose(60)
BASE = prose(120)
NEAR = [" ".join(w if i != 7 * k + 3 else "zz" for i, w in enumerate(BASE.split())) for k in range(6)]
TEXTS = [None, "", " ", "one two", "ONE Two", "a\na\n a\n\nb " * 3, prose(30) + " " + PASSAGE, PASSAGE + "\n" + prose(25), prose(10) + "\t" + PASSAGE + " " + PASSAGE, BASE, BASE, BASE.upper(), *NEAR, prose(3000), "日本語 テスト " * 12, "!!! ??? 123", "mail a@b.c%d@e.f x 1.2.3.4.5.6.7.8 300.1.1.1 +1 (743) 555-3824 4381-8935-5774-1609 2021 4381893557741609", "x" * 5000 + " " + "y " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 1, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, token string").repartition(3).cache()


def words(t):
    return re.findall(WORD, t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_counts(docs):
    got = by_id(quality.quality_rules(docs))
    for i, t in enumerate(TEXTS):
        w = words(t)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        r = got[i * 3]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_substring_matches_brute_force(docs):
    got, seen = by_id(substring.removed_words(docs)), set()
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        r = got[i * 3]
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(docs, percent):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i * 3] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = by_id(minhash.near_duplicates(docs, percent))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_packing_covers_every_id_once(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i * 3], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packer_keeps_proportions():
    p = packing.Packer({"a": 0.5, "b": 0.3, "c": 0.2}, 2048, 64, 0)
    for s, n in (("a", 50), ("b", 30), ("c", 20)):
        for i in range(n):
            p.add(s, i, np.zeros(1024, np.uint16), 0, 1024)
    served = Counter()
    for w in range(40):
        p.rows = [[] for _ in p.rows]
        p.window()
        for s, n in zip(p.rows[7], p.rows[2]):
            served[s] += n
        total = sum(served.values())
        assert total == 2048 * (w + 1) and all(abs(served[s] - share * total) <= 256 for s, share in p.targets.items())


def test_token_counts(docs):
    import sentencepiece
    from public_tokenizers import path

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = by_id(token_counts.token_counts(docs, table_size=64))
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert (got[i * 3].n_bytes, got[i * 3].n_tokens, got[i * 3].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_pii_base_spans(docs):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    got = by_id(pii.find(docs))
    for i, t in enumerate(TEXTS):
        found = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in base for m in re.finditer(p, t or "") if ok(m[0])]
        r = got[i * 3]
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert set(found) <= set(filter(None, r.spans.split(",")))
    assert "4381-8935-5774-1609" not in by_id(pii.redact(docs))[60].text and by_id(pii.redact(docs))[27].text == BASE


def test_warc_round_trip(spark):
    big = "é" * 1_500_000
    rows = [(1, "u v", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", big), (0, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: got[i].refers_to for i in got} == {0: None, 1: 0, 2: 0, 3: None, 4: None, 5: None, 6: None} and got[1].record_type == "revisit"
    chunks = warc.read_archives(spark, warc.write_archives(pages.where("page_id = 6"))).orderBy("chunk_number").collect()
    assert len(chunks) == 3 and b"".join(c.content for c in chunks) == big.encode()


def test_neighbours_recall(spark):
    v = RNG.normal(size=(1500, 16))
    v[100:400] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 20 = 0"), shard_rows=600).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        hits += len({i for i, _ in got[q]} & set(want))
        assert all(abs(x - s[i]) < 1e-9 for i, x in got[q]) and len(got[q]) == 20
    assert hits / (75 * 20) >= 0.9


def test_language_rules(spark):
    learned = spark.createDataFrame([(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, None), (2, "123 !!"), (3, "the dog"), (4, "die katze")], "doc_id long, text string")
    got = by_id(langid.identify(asked, learned))
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "en", "de"] and all(0 <= r.score <= 1 for r in got.values())
    assert by_id(langid.identify(asked, learned.where("false")))[3].lang_pred == "und"


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (quality.quality_rules, substring.removed_words, minhash.near_duplicates, packing.pack, token_counts.token_counts, pii.find):
        assert f(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(vectors, vectors).count() == 0
