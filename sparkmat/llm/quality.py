"""Quality rules: word and line repetition limits, then tokeniser fertility.

Fertility of a whole text under a public vocabulary is measured by characters per token, the share of
byte-fallback tokens and the entropy of its token distribution; a band per script (that of most of its
letters, ``SCRIPTS``) rejects texts outside. Long texts repeat tokens, so for Latin texts the least entropy is also
a curve over the number of tokens: of documents of sf0.1 that pass the base rule and are neither tables nor
stutter it lies under about 0.2 % at each length. Other scripts were not measured and have wide bands only;
``fit_bands`` derives bands from a corpus' percentiles over all its rows.

A null or empty text has zeros everywhere, fails the base rule (under 20 words) and has null fertility.
Invalid UTF-8 counts a code point for each byte that is no continuation; its letters there are none. Repeated rows
and rows without a doc_id are judged each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmat.llm import _text as X
from sparkmat.llm._spark import texts
from sparkmat.llm._tokens import cache

WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Inclusive limits; entropy is judged relative to about the most that n tokens allow, log2(min(n, 1024) + 1).

    ``floor``: points (log2 n, least bits), joined by lines; none under the first, level after the last.
    """

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float
    floor: tuple[tuple[float, float], ...] = ()

    def least_bits(self, n: np.ndarray) -> np.ndarray:
        if not self.floor:
            return np.zeros(len(n))
        at, bits = zip(*self.floor)
        return np.interp(np.log2(np.maximum(n, 1)), at, bits, left=0.0)


# First code points of the Unicode ranges of scripts, in order; "" for ranges of no script below.
RANGES = [
    (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"), (0x780, "other"),
    (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2E00, ""), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0x20000, "han"), (0x32000, ""),
]
_LATIN = ((4.3, 2.55), (5.5, 4.715), (6.5, 5.176), (7.5, 5.628), (8.5, 5.811), (9.5, 5.928), (10.5, 6.04), (11.5, 6.166), (12.5, 6.197), (13.5, 6.206))
_LETTERS, _SIGNS = Band(0.6, 6.0, 0.60, 0.25), Band(0.3, 6.0, 0.95, 0.25)
#: Per script of most letters ("none": no letter). Only Latin was measured.
BANDS = {"latin": Band(1.3, 7.0, 0.20, 0.58, _LATIN)} | dict.fromkeys(("greek", "cyrillic", "hebrew", "arabic", "georgian"), _LETTERS) | dict.fromkeys(("devanagari", "indic", "thai", "hangul", "kana", "han", "other"), _SIGNS) | {"none": Band(0.3, 16.0, 0.95, 0.0)}
SCRIPTS = list(BANDS)
_FIRST = np.array([a for a, _ in RANGES], np.uint32)
_SCRIPT = np.array([-1, *(SCRIPTS.index(s) if s else -1 for _, s in RANGES)])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, kept boolean"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_DOC = np.uint64(0x9FB21C651E98DF25)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return order, key[order][1:] == key[order][:-1]


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    newline = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    end = np.searchsorted(newline, begin)
    stop = offsets[np.searchsorted(offsets, begin, "right")]
    end = np.minimum(np.append(newline, len(data))[end], stop)
    has = np.searchsorted(word_starts, begin) < np.searchsorted(word_starts, end)
    begin, end = begin[has], end[has]
    text = np.searchsorted(offsets, begin, "right") - 1
    order, same = _runs(X.mix(X.span_hash(data, begin, end) + text.astype(np.uint64) * _DOC))
    return np.bincount(text[order[1:][same]], minlength=len(offsets) - 1)


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    n_texts = len(first) - 1
    g, ok = X.ngram_hash(h, WINDOW), X.ngram_starts(first, WINDOW)
    if not len(g):
        return np.zeros(n_texts, np.int64)
    at = np.flatnonzero(ok)
    text = X.text_of(first)[at]
    order, same = _runs(X.mix(g[at] + text.astype(np.uint64) * _DOC))
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + WINDOW, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, first)


def fertility(tokens: np.ndarray, offsets: np.ndarray, fallback: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of tokens, of byte-fallback tokens, and entropy in bits."""
    n = np.diff(offsets)
    if not len(tokens):
        return n, n * 0, np.zeros(len(n))
    text = np.repeat(np.arange(len(n)), n)
    key = np.sort(text << 16 | tokens)
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    c = np.diff(np.append(edge, len(key)))
    s = np.bincount(key[edge] >> 16, c * np.log2(c), minlength=len(n))
    some = np.maximum(n, 1)
    return n, _per_text(fallback[tokens], offsets), np.maximum(np.log2(some) - s / some, 0)


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index in ``SCRIPTS`` of the script of most letters of each text, the first on ties."""
    n = len(offsets) - 1
    letters = _per_text(((data | 32) >= 97) & ((data | 32) <= 122), offsets)
    votes = np.zeros((n, len(SCRIPTS) - 1), np.int64)
    votes[:, 0] = letters
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        # Code points of the other characters, from their bytes; what is cut off reads as zeros and is no letter.
        tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b, c, d, e = (tail[lead + i] & (0xFF if i == 0 else 0x3F) for i in range(4))
        point = np.where(b < 0xE0, (b & 0x1F) << 6 | c, np.where(b < 0xF0, (b & 0x0F) << 12 | c << 6 | d, (b & 0x07) << 18 | c << 12 | d << 6 | e))
        script = _SCRIPT[np.searchsorted(_FIRST, point, "right")]
        some = script >= 0
        text = np.searchsorted(offsets, lead[some], "right") - 1
        np.add.at(votes, (text, script[some]), 1)
    return np.where(votes.any(1), votes.argmax(1), len(SCRIPTS) - 1)


def judge(column: pa.Array, bands: dict[str, Band], model: str) -> dict[str, pa.Array]:
    """The columns of ``SCHEMA`` but doc_id for an Arrow column of texts."""
    pieces, cols = cache(model), [[np.zeros(0, t)] for t in (int, int, int, int, int, bool, int, int, int, float, int)]
    for _, _, data, offsets in X.blocks(column):
        starts, ends, first = X.word_spans(data, offsets)
        words = np.diff(first)
        points = X.count_points(data, offsets)
        repeat = repeated_words(X.span_hash(data, starts, ends), first)
        ids, at = pieces.tokens(data, offsets)
        n, low, entropy = fertility(ids, at, pieces.coder.bytes)
        script = scripts(data, offsets)
        failed = (words < 20) | (100 * repeat > 30 * words)
        white = _per_text(X.SPACE[data], offsets)
        for c, v in zip(cols, (words, points - white, _per_text(_SYMBOL[data], offsets), duplicate_lines(data, offsets, starts), repeat, failed, n, points, low, entropy, script)):
            c.append(v)
    words, chars, symbols, lines, repeat, failed, n, points, low, entropy, script = map(np.concatenate, cols)
    none, some = n == 0, np.maximum(n, 1)
    limits = np.array([[b.least_chars, b.most_chars, b.most_fallback, b.least_entropy] for b in map(bands.__getitem__, SCRIPTS)])[script]
    in_band = (points / some >= limits[:, 0]) & (points / some <= limits[:, 1]) & (low / some <= limits[:, 2]) & (entropy >= limits[:, 3] * np.log2(np.minimum(n, 1024) + 1)) & ~none
    for i, name in enumerate(SCRIPTS):
        in_band &= (script != i) | (entropy >= bands[name].least_bits(n))
    values = (words, chars, symbols, lines, repeat, failed, n)
    arrays = [*map(pa.array, values), pa.array(points / some, mask=none), pa.array(low / some, mask=none), pa.array(entropy, mask=none), pa.array(np.array(SCRIPTS, object)[script], pa.string()), pa.array(~failed & in_band)]
    return dict(zip([c.split()[0] for c in SCHEMA.split(", ")][1:], arrays))


def quality_rules(docs: DataFrame, bands: dict[str, Band] = BANDS, model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per text (``SCHEMA``); ``kept``: neither ``base_failed`` nor outside its script's fertility band."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | judge(batch.column(1), bands, model))

    return texts(docs).mapInArrow(run, SCHEMA)


def filter_documents(docs: DataFrame, bands: dict[str, Band] = BANDS, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns; workers get the texts and give a verdict, rows stay where they are."""

    @F.arrow_udf("boolean")
    def keep(text: pa.Array) -> pa.Array:
        return judge(text, bands, model)["kept"]

    return docs.where(keep(F.col("text").cast("string")))


def fit_bands(measured: DataFrame, low: float = 0.0005, high: float = 0.9995) -> dict[str, Band]:
    """Bands from percentiles over all rows of ``quality_rules`` that pass the base rule; at most one per script."""
    p = lambda c, q: F.percentile_approx(c, q, 10000)
    most = F.log2(F.least(F.col("n_tokens"), F.lit(1024)) + 1)
    passed = measured.where(~F.col("base_failed"))
    floors: dict[str, list] = {}
    for r in passed.groupBy("script", F.floor(F.log2("n_tokens")).alias("at")).agg(p("token_entropy", low).alias("bits")).orderBy("script", "at").collect():
        floors.setdefault(r.script, []).append((r["at"] + 0.5, r.bits))
    rows = passed.groupBy("script").agg(p("chars_per_token", low).alias("a"), p("chars_per_token", high).alias("b"), p("fallback_share", high).alias("c"), p(F.col("token_entropy") / most, low).alias("d")).collect()
    return BANDS | {r.script: Band(r.a, r.b, r.c, r.d, tuple(floors[r.script])) for r in rows}
