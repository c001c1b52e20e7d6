"""Exact tokenisation of whole texts by independent byte spans and a per-worker cache.

A text is cut only where neither library can form a token across the cut, so the ids of the text are
the ids of its spans in order:

* byte-level BPE (GPT-2 split pattern): before a white-space byte that follows other text, and after a
  single non-blank white-space byte that ASCII text follows;
* the sentencepiece BPE file: before a blank that follows other text, for no piece holds the blank mark
  after another character (checked on load), merges never cross it.

Spans go through a direct-mapped cache keyed by their 64-bit hash; only misses reach the library.
"""

from __future__ import annotations

import base64

import numpy as np

from sparkmat.llm._text import KEPT, SPACE, only, span_hash

CACHE_BITS = 20
POOL_IDS = 6_000_000
SPECIAL = "<|endoftext|>"
_loaded: dict[str, object] = KEPT.setdefault("spans", {})


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = white[1:] & ~white[:-1]
    plain = ~white & (data < 0x80)
    if n > 1:
        lone = white[:-1] & (data[:-1] != 0x20) & plain[1:]
        lone[1:] &= ~white[:-2]
        cut[1:n] |= lone
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = data == 0x20
    cut = np.zeros(n + 1, bool)
    cut[1:n] = blank[1:] & ~blank[:-1] & (data[:-1] != 0x81)  # 0x81 may end U+2581, the blank mark itself
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class BytePairs:
    """``byte_bpe_50k.json``: its rank file gives the same ids faster; spans with the special string use the json."""

    spans = staticmethod(bpe_spans)

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self.json = path, None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str], first: list[bool]) -> list[list[int]]:
        out = []
        for p in pieces:
            if SPECIAL in p:
                if self.json is None:
                    from tokenizers import Tokenizer

                    self.json = Tokenizer.from_file(self.path)
                out.append(self.json.encode(p, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(p))
        return out


class Pieces:
    """``piece_bpe_32k.model``."""

    spans = staticmethod(piece_spans)

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = self.model.id_to_piece(list(range(n)))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds the blank mark after another character; spans are not independent")
        self.bytes = np.array([self.model.is_byte(i) for i in range(n)])
        self.blank = self.model.piece_to_id("▁")

    def encode(self, pieces: list[str], first: list[bool]) -> list[list[int]]:
        # The library puts a blank before what it encodes: give it the span without its own first blank.
        # A text's first span has that blank besides its own.
        bare = [p if f else p[1:] for p, f in zip(pieces, first)]
        return [x if p else [self.blank] for x, p in zip(self.model.encode(bare, num_threads=1), bare)]


class SpanCache:
    """Direct-mapped span hash -> token ids. Bounded: 2**CACHE_BITS slots and POOL_IDS ids, then it starts anew."""

    def __init__(self, coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        n = 1 << CACHE_BITS
        self.keys = ~(np.arange(n, dtype=np.uint64) << np.uint64(64 - CACHE_BITS))  # none belongs to its slot
        self.at, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0

    def lookup(self, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
        """Of each span: its place in ``pool`` and its number of ids; ``first``: mask of spans that begin a text."""
        if self.used > POOL_IDS:
            self.clear()
        h = span_hash(data, starts, ends) ^ (first.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        slot = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        at, length = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, pick, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[pick]
            raw = data.tobytes() if len(pick) > 64 else None
            text = [(raw[s:e] if raw is not None else data[s:e].tobytes()).decode("utf-8", "replace") for s, e in zip(starts[pick].tolist(), ends[pick].tolist())]
            ids = self.coder.encode(text, first[pick].tolist())
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(n.sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint16)])
            self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint16, total)
            place = self.used + np.cumsum(n) - n
            self.used += total
            at[miss], length[miss] = place[back], n[back]
            self.keys[slot[pick]], self.at[slot[pick]], self.length[slot[pick]] = h[pick], place, n
        return at, length

    def tokens(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after another, and the offsets of each text in them."""
        starts, ends = self.coder.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        at, length = self.lookup(data, starts, ends, begins[starts])
        done = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=done[1:])
        where = np.repeat(at - done[:-1], length)
        where += np.arange(len(where))
        return self.pool[where], done[np.searchsorted(starts, offsets)]


def cache(name: str) -> SpanCache:
    """This worker's cache for a vocabulary file (a name of the public files or a path); it keeps one at a time."""
    only("spans")
    if name not in _loaded:
        _loaded.clear()
        path = name if "/" in name else vocabulary_path(name)
        _loaded[name] = SpanCache((Pieces if path.endswith(".model") else BytePairs)(path))
    return _loaded[name]
