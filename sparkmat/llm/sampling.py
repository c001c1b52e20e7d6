"""SentencePiece encoding, decoding and sampling of distinct segmentations (Gumbel top-k without replacement).

``sample`` draws ``k`` distinct segmentations of each whole text from p(s) ~ exp(alpha * sum of piece scores)
by an A* search over the lattice of its pieces. A node of the search is a prefix together with the arcs still
open at its end; its priority is the largest perturbed log-probability (Gumbel noise added) of the
segmentations below it, drawn top down: the parent's value belongs to one child, the others are Gumbel
variables truncated at it. Priorities are exact maxima, so the search pops the k best segmentations one by
one and each pop completes one path. As backward sums make every arc's probability local, a path is sampled
for all words of a block of texts at once, and only its k best siblings can ever be popped; the searches of a
block's texts advance together, a pop each.

The inclusion score of a sample is log P(its perturbed value exceeds the (k+1)-th best); exp(log_prob -
log_inclusion) weights give unbiased sums over all segmentations (a sum with all of them has score 0).

Pieces never hold the blank mark after another character (checked on load), so words have lattices of their
own and these are cached, up to ``CACHE_STATES`` positions and a block's. Noise comes from a counter hashed
with ``seed`` and the row's doc_id: results depend neither on partitions nor on other rows.

The vocabulary given is a BPE one, whose scores are ranks and not log-probabilities: a piece of rank r then
has the score -log(r + 1) (Zipf's law); unigram files use their own scores. Characters outside the
vocabulary are one arc, written as byte pieces.

Null and empty texts have one segmentation, the empty one; texts with fewer than k segmentations return all
of them; invalid UTF-8 reads as replacement characters; a null doc_id is seeded as 0; repeated rows return the
same samples again; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkmat.llm import _text as X
from sparkmat.llm._spark import texts
from sparkmat.llm._text import mix
from sparkmat.llm._tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
#: The blank mark. Inside this module normalised texts have a blank in its place.
BLANK = "▁"
CACHE_STATES = 1 << 20
BLOCK_BYTES = 1 << 19
#: Steps of a path whose noise is always drawn; of the rest only those that can still be among the k best.
EARLY = 64
#: No more than this is the noise of a 53-bit draw: -log(-log(1 - 2**-54)).
MOST_NOISE = 37.5
#: Log-probabilities are summed along a path in whole units of this, so sums do not depend on the block.
UNIT = 2.0**-36
_SLOTS = 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_loaded: dict[tuple, Lattices] = X.KEPT.setdefault("lattices", {})


class _Rows:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1 << 12, dtype), 0

    def clear(self, most: int) -> None:
        """Empty it; the room stays if it is for ``most`` elements or fewer."""
        if len(self.a) > most:
            self.a = np.zeros(1 << 12, self.a.dtype)
        self.n = 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            more = np.zeros(max(len(self.a), self.n + len(x) - len(self.a)), self.a.dtype)
            self.a = np.concatenate([self.a, more])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


class Lattices:
    """The vocabulary and the cached lattices of its words, as arcs by state (a position in a word)."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        path = vocabulary_path(model)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.plain_blanks = _only_marks_blanks(path)
        n = sp.get_piece_size()
        self.byte_id = {int(p[3:5], 16): i for i in range(n) if sp.is_byte(i) for p in [sp.id_to_piece(i)]}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) for s in score.values()):
            score = {i: -math.log1p(-s) for i, s in score.items()}
        pieces = {sp.id_to_piece(i).replace(BLANK, " "): i for i in plain}
        if any(re.search("[^ ] ", p) for p in pieces):
            raise ValueError("a piece holds the blank mark after another character")
        self.longest = max(map(len, pieces))
        self._index(*_entries(list(pieces), np.array(list(pieces.values()))))
        self.score = np.full(n + 1, alpha * (min(score.values()) - 10))  # the last one: an unknown character
        self.score[list(score)] = alpha * np.array(list(score.values()))
        # Ids of an arc: one, or the bytes of a character outside the vocabulary.
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(n)))]
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._ends = _Rows(np.int32)  # where the arcs of a state begin, one longer than the states
        self._cum = _Rows(np.float64)  # probability of the state's arcs up to this one
        self._logp, self._rest = _Rows(np.float64), _Rows(np.float64)
        self._to = _Rows(np.int32)  # the first arc of the state it leads to, -1 at the word's end
        self._piece = _Rows(np.int32)  # -1 - c for a character c outside the vocabulary
        self.clear()

    def _index(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Entries by the top bits of their hash; those whose slot is taken stand in a small sorted list."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        more = np.setdiff1d(np.arange(len(h)), first)
        self.slot_hash, self.slot_entry = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32)
        self.slot_hash[slot[first]], self.slot_entry[slot[first]] = h[first], entries[first]
        more = more[np.argsort(h[more])]
        self.more_hash, self.more_entry = np.append(h[more], np.uint64(2**64 - 1)), np.append(entries[more], 0)
        self.crowded = np.zeros(1 << _SLOTS, bool)
        self.crowded[slot[more]] = True

    def _entries(self, h: np.ndarray) -> np.ndarray:
        """The entries of the hashes, 0 where there is none."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        entry = self.slot_entry[slot]
        other = np.flatnonzero(entry)
        other = other[self.slot_hash[slot[other]] != h[other]]
        entry[other] = 0
        other = other[self.crowded[slot[other]]]
        if len(other):
            at = np.searchsorted(self.more_hash, h[other])
            entry[other] = np.where(self.more_hash[at] == h[other], self.more_entry[at], 0)
        return entry

    def clear(self) -> None:
        """Drop all words; the arrays keep their room unless a long text needed more than the cache does."""
        self.key = ~(np.arange(1 << _SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOTS))  # word hash by slot; none belongs to its own
        self.first = np.zeros(1 << _SLOTS, np.int32)
        for rows in (self._ends, self._cum, self._logp, self._rest, self._to, self._piece):
            rows.clear(8 * CACHE_STATES)
        self._ends.add(np.zeros(1, np.int32))

    @property
    def arcs(self) -> np.ndarray:
        return self._ends.a[: self._ends.n]

    @property
    def logp(self) -> np.ndarray:
        return self._logp.a

    def _arcs(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Source, length, piece (-1: unknown character) and rank of all arcs, and the arcs of each position; left: characters to the word's end."""
        own = _point(points)
        at, h, found, width = np.arange(len(points), dtype=np.int32), np.zeros(len(points), np.uint64), [], np.zeros(len(points), np.int32)
        for n in range(1, self.longest + 1):
            if n > 1:
                ok = np.flatnonzero(((entry & 1) > 0) & (left[at] >= n))  # only beginnings of a piece go on
                at, h = at[ok], h[ok]
                if not len(at):
                    break
            h = h * _A
            h += own[at + (n - 1)]
            entry = self._entries(h)
            hit = np.flatnonzero(entry > 1)
            src, piece = at[hit], (entry[hit] >> 1) - 1
            if n == 1:
                lone = np.ones(len(points), bool)
                lone[src] = False
                lone = np.flatnonzero(lone).astype(np.int32)
                src, piece = np.concatenate([src, lone]), np.concatenate([piece, np.full(len(lone), -1, np.int32)])
            found.append((src, np.full(len(src), n, np.int32), piece, width[src]))
            width[src] += 1
        return *map(np.concatenate, zip(*found)), width

    def add(self, text: str, size: np.ndarray) -> np.ndarray:
        """First arcs of new words: ``text`` has them one after another, ``size`` their characters."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(size)
        count, n = self._logp.n, len(points)
        left = np.repeat(ends, size) - np.arange(n)
        src, length, piece, rank, width = self._arcs(points, left)
        # Arcs stand by the distance of their source from its word's end: backward sums go over all words at once.
        by_left = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        begin = np.concatenate([[0], np.cumsum(width[by_left])])
        start = np.empty(n, np.int64)
        start[by_left] = begin[:-1]
        place = start[src] + rank
        value, to, beta = np.empty(len(src)), np.empty(len(src), np.int32), np.zeros(n + 1)
        value[place], to[place] = self.score[piece], np.where(length == left[src], n, src + length)
        cut = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        for a, b in zip(cut[:-1], cut[1:]):
            if a < b:
                lo, hi = begin[a], begin[b]
                value[lo:hi] += beta[to[lo:hi]]
                at = begin[a:b] - lo
                top = np.maximum.reduceat(value[lo:hi], at)
                beta[by_left[a:b]] = top + np.log(np.add.reduceat(np.exp(value[lo:hi] - np.repeat(top, np.diff(begin[a : b + 1]))), at))
        value = value[place] - beta[src]
        # Into the order of the states, the likeliest arc first.
        begin = np.cumsum(width) - width
        place = begin[src] + rank
        ordered = np.empty(len(src))
        ordered[place] = value
        tops = np.flatnonzero(value == np.maximum.reduceat(ordered, begin)[src])
        best = np.empty(n, np.int64)
        best[src[tops]] = tops
        firsts = np.flatnonzero(rank == 0)
        place[firsts], place[best] = place[best[src[firsts]]], begin
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        src, piece, value, length = src[order], piece[order], value[order], length[order]
        to = np.where(length == left[src], -1, count + np.append(begin, 0)[src + length])
        p = np.exp(value)
        likeliest = p[begin]
        p[begin] = 0.0
        others = np.add.reduceat(p, begin)
        p[begin] = likeliest
        rest = 1 - p
        rest[begin] = others  # summed: it may be far under the rounding of 1 - p
        total = np.cumsum(p)
        cum = total - np.repeat(total[begin] - likeliest, width)
        cum[begin + width - 1] = 1.0
        value[begin[width == 1]] = 0.0
        odd = np.flatnonzero(piece < 0)
        piece[odd] = -1 - points[src[odd]].astype(np.int32)
        self._ends.add(count + begin + width)
        self._cum.add(cum)
        self._logp.add(value)
        self._rest.add(np.log(np.maximum(rest, 0.0)))
        self._to.add(to)
        self._piece.add(piece)
        return count + begin[ends - size]

    def states(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First arc of each word; all arcs stay valid until the next call."""
        if self._ends.n > CACHE_STATES:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int32)
        h = X.span_hash(data, starts, ends)
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.first[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            u, pick, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[pick]
            s, n = starts[pick], ends[pick] - starts[pick]
            raw = data[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]
            size = X.count_points(raw, np.concatenate([[0], np.cumsum(n)]))
            new = self.add(raw.tobytes().decode("utf-8"), size)
            out[miss] = new[back]
            self.key[slot[pick]], self.first[slot[pick]] = u, new
        return out

    def ids_of(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the arcs, and how many each has."""
        ids = self._piece.a[arcs]
        n = np.ones(len(ids), np.int8)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, n
        points, which = np.unique(-1 - ids[odd], return_inverse=True)
        own = [[self.byte_id.get(b, 0) for b in chr(c).replace(" ", BLANK).encode()] if self.byte_id else [0] for c in points.tolist()]
        size = np.array(list(map(len, own)))
        n[odd] = size[which]
        ids = np.repeat(ids, n)
        ids[ids < 0] = np.concatenate(own)[_ranges((np.cumsum(size) - size)[which], size[which])]
        return ids, n

    def normal(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of a block's normalised texts, blanks in place of blank marks."""
        raw = data.tobytes()
        if self.plain_blanks and _valid(raw) and BLANK.encode() not in raw:
            some = np.diff(offsets) > 0
            more = np.concatenate([[0], np.cumsum(some)])
            return np.insert(data, offsets[:-1][some], 0x20), offsets + more
        parts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = raw[a:b].decode("utf-8", "replace")
            parts.append((self.sp.normalize(text) if text else "").replace(BLANK, " ").encode())
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _fields(blob: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 2: None, 5: 4}[tag & 7]
            n = varint() if n is None else n
            yield tag >> 3, blob[at : at + n]
            at += n


def _only_marks_blanks(path: str) -> bool:
    """Whether normalisation only puts the mark for each blank and one before a text (field 3 of a model file)."""
    with open(path, "rb") as f:
        spec = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 3]
    rule = spec[0] if spec else {}
    # 1 name, 2 compiled rules, 3 dummy prefix, 4 remove extra blanks, 5 mark blanks, 6 rules.
    return bool(spec) and not rule.get(2) and bool(rule.get(3, 1)) and not rule.get(4, 1) and bool(rule.get(5, 1)) and not rule.get(6)


def _point(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + _B)


def _entries(pieces: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces and beginnings of pieces, and their entries: twice the piece + 1 (0: none), and 1 more if a longer piece begins so."""
    size = np.array(list(map(len, pieces)))
    own = _point(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32))
    at, h, found = np.cumsum(size) - size, np.zeros(len(size), np.uint64), []
    for n in range(int(size.max())):
        ok = size > n
        size, ids, at, h = size[ok], ids[ok], at[ok], h[ok] * _A
        h += own[at + n]
        found.append((h, np.where(size == n + 1, 2 * (ids + 1), 1).astype(np.int32)))
    h, entry = map(np.concatenate, zip(*found))
    order = np.argsort(h)
    h, first = np.unique(h[order], return_index=True)
    return h, np.bitwise_or.reduceat(entry[order], first)


def lattices(model: str, alpha: float) -> Lattices:
    key = model, alpha
    X.only("lattices")
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Lattices(model, alpha)
    return _loaded[key]


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1), never an end."""
    return ((mix(h) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``count`` long, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _walk(lat: Lattices, state: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled arcs from each state (its first arc) to its word's end, one start after another, and how many each has."""
    arc, whose, step, parts, length = state.copy(), np.arange(len(state), dtype=np.int32), 0, [], np.zeros(len(state), np.int64)
    cum, to = lat._cum.a, lat._to.a
    while len(arc):
        # The noise of a word's step is a counter's hash: the same whatever else is in the block.
        u = _uniform(noise[whose] + np.uint64(step) * _C)
        late = np.flatnonzero(u >= cum[arc])  # arcs go from the likeliest on, so most are found at once
        while len(late):
            arc[late] += 1
            late = late[u[late] >= cum[arc[late]]]
        parts.append((whose, arc))
        length[whose] = step + 1
        arc = to[arc]
        go = np.flatnonzero(arc >= 0)
        arc, whose, step = arc[go], whose[go], step + 1
    out = np.empty(int(length.sum()), np.int32)
    begin = np.cumsum(length) - length
    for step, (whose, arc) in enumerate(parts):
        out[begin[whose] + step] = arc
    return out, length


def _truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``loc``, truncated at ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - loc)


@dataclass
class _Paths:
    """The paths that one turn completed: of text ``text[i]`` the arcs [at[i], at[i + 1]), their words and log-probabilities."""

    text: np.ndarray
    at: np.ndarray
    arc: np.ndarray
    word: np.ndarray
    logp: np.ndarray
    value: np.ndarray


class _Frontier:
    """The k best open nodes of each text: path and step whose arcs are open, but for the closed ones."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.value = np.full((n, k), -np.inf)
        self.path, self.step, self.before = np.zeros((n, k), np.int32), np.zeros((n, k), np.int64), np.zeros((n, k))
        self.closed = np.full((n, k, k), -1, np.int32)

    def push(self, text: np.ndarray, value, path, step, before, closed) -> None:
        """Nodes of distinct or repeated texts, the better ones of a text first."""
        while len(text):  # one node of each text at a time takes the place of its worst
            _, one = np.unique(text, return_index=True)
            t, worst = text[one], self.value[text[one]].argmin(1)
            better = value[one] > self.value[t, worst]
            t, w, i = t[better], worst[better], one[better]
            self.value[t, w], self.path[t, w], self.step[t, w], self.before[t, w] = value[i], path[i], step[i], before[i]
            self.closed[t, w] = closed[i]
            left = np.ones(len(text), bool)
            left[one] = False
            text, value, path, step, before, closed = (x[left] for x in (text, value, path, step, before, closed))


def _grow(lat, offsets, first, seeds, turn, k, text, head, extra, base, value, word, inside, paths, front) -> None:
    """Complete a path of each text.

    head: (path, its offset, length) kept of an earlier path; extra: the arc after it (-1: none); base: their
    log-probability; word: the next word of the text; inside: the first arc of the state in it, or -1 for the word's first.
    """
    count = offsets[text + 1] - offsets[text] - word
    state = first[_ranges(offsets[text] + word, count)]
    own = np.repeat(np.arange(len(text)), count)
    begin = np.cumsum(count) - count
    mid = np.flatnonzero(inside >= 0)
    state[begin[mid]] = inside[mid]
    words = _ranges(word, count)
    noise = mix(seeds[text][own] + np.uint64(turn) * _B + words.astype(np.uint64) * _A)
    arc, length = _walk(lat, state, noise)
    tail = np.bincount(own, length, minlength=len(text)).astype(np.int64)
    whose = np.repeat(own, length)
    at = np.cumsum(tail) - tail
    place = np.arange(len(arc)) - at[whose]
    # The whole paths: head, extra arc, tail.
    more = (extra >= 0).astype(np.int64)
    size = head[2] + more + tail
    ends = np.concatenate([[0], np.cumsum(size)])
    path = _Paths(text, ends, *(np.empty(int(ends[-1]), t) for t in (np.int32, np.int32, np.float64)), value)
    for p in np.unique(head[0][head[2] > 0]):
        mine = np.flatnonzero((head[0] == p) & (head[2] > 0))
        source, target = _ranges(head[1][mine], head[2][mine]), _ranges(ends[:-1][mine], head[2][mine])
        path.arc[target], path.word[target], path.logp[target] = paths[p].arc[source], paths[p].word[source], paths[p].logp[source]
    has = np.flatnonzero(more)
    target = ends[:-1][has] + head[2][has]
    path.arc[target], path.word[target], path.logp[target] = extra[has], word[has] - (inside[has] < 0), lat.logp[extra[has]]
    target, logp = _ranges(ends[:-1] + head[2] + more, tail), lat.logp[arc]
    path.arc[target], path.word[target], path.logp[target] = arc, np.repeat(words, length), logp
    paths.append(path)
    # Open siblings along the tail: their truncated maxima, as far as they can be among the k best.
    units = np.rint(logp / UNIT).astype(np.int64)
    total = np.cumsum(units) - units
    before = base[whose] + (total - np.repeat(total[at[tail > 0]], tail[tail > 0])) * UNIT
    loc = before + lat._rest.a[arc]

    def drawn(i: np.ndarray) -> np.ndarray:
        u = _uniform((seeds[text[whose[i]]] ^ _C) + np.uint64(turn) * _A + place[i].astype(np.uint64) * _B)
        return _truncated(loc[i], value[whose[i]], u)

    early = np.flatnonzero((place < EARLY) & (loc > -np.inf))
    noise = drawn(early)
    grid = np.full((len(text), max(EARLY, k)), -np.inf)
    grid[whose[early], place[early]] = noise
    floor = np.partition(grid, grid.shape[1] - k, axis=1)[:, grid.shape[1] - k]
    late = np.flatnonzero((place >= EARLY) & (loc + MOST_NOISE > floor[whose]))
    step, noise = np.concatenate([early, late]), np.concatenate([noise, drawn(late)])
    some = np.flatnonzero(noise >= floor[whose[step]])  # k of a text reach its floor, if it has as many
    step, noise = step[some], noise[some]
    order = np.lexsort((place[step], -noise, whose[step]))
    step, noise = step[order], noise[order]
    top = np.arange(len(step)) - np.searchsorted(whose[step], whose[step]) < k
    step, noise = step[top], noise[top]
    closed = np.full((len(step), k), -1, np.int32)
    closed[:, 0] = arc[step]
    front.push(text[whose[step]], noise, np.full(len(step), turn), (head[2] + more)[whose[step]] + place[step], before[step], closed)


def _pop(lat, seeds, turn, front, paths) -> tuple:
    """The best open node's best arc of every text that has one, for _grow; its other arcs go back to the frontier."""
    text = np.flatnonzero(front.value.max(1) > -np.inf)
    col = front.value[text].argmax(1)
    value, path, step, before, closed = (x[text, col] for x in (front.value, front.path, front.step, front.before, front.closed))
    front.value[text, col] = -np.inf
    at, old, word = np.zeros(len(text), np.int64), np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
    for p in np.unique(path):
        mine = np.flatnonzero(path == p)
        at[mine] = paths[p].at[np.searchsorted(paths[p].text, text[mine])]
        old[mine], word[mine] = paths[p].arc[at[mine] + step[mine]], paths[p].word[at[mine] + step[mine]]
    state = np.searchsorted(lat.arcs, old, "right") - 1  # that old leaves
    lo, hi = lat.arcs[state].astype(np.int64), lat.arcs[state + 1].astype(np.int64)
    every = lo[:, None] + np.arange(int((hi - lo).max(initial=1)))
    ok = (every < hi[:, None]) & ~(every[:, :, None] == closed[:, None, :]).any(2)
    logp = np.where(ok, lat.logp[np.minimum(every, hi[:, None] - 1)], -np.inf)
    u, v = (_uniform((seeds[text] ^ _A) + np.uint64(2 * turn + i) * _C) for i in (0, 1))
    p = np.exp(logp - logp.max(1, keepdims=True))
    cum = np.cumsum(p, 1)
    last = ok.shape[1] - 1 - ok[:, ::-1].argmax(1)
    pick = np.minimum((cum <= (u * cum[:, -1])[:, None]).sum(1), last)
    rows = np.arange(len(text))
    arc = every[rows, pick].astype(np.int32)
    here = logp[rows, pick].copy()
    logp[rows, pick] = -np.inf
    more = np.flatnonzero(logp.max(1, initial=-np.inf) > -np.inf)
    peak = logp[more].max(1)
    loc = before[more] + peak + np.log(np.exp(logp[more] - peak[:, None]).sum(1))
    shut = closed[more]
    shut[np.arange(len(more)), (shut >= 0).sum(1)] = arc[more]
    front.push(text[more], _truncated(loc, value[more], v[more]), path[more], step[more], before[more], shut)
    to = lat._to.a[arc]
    return text, (path, at, step), arc, before + here, value, word + (to < 0), to


@dataclass
class Samples:
    """The samples of a block, text by text and best first; sample i has the ids [ids_at[i], ids_at[i + 1])."""

    text: np.ndarray
    rank: np.ndarray
    log_prob: np.ndarray
    value: np.ndarray
    log_inclusion: np.ndarray
    ids: np.ndarray
    ids_at: np.ndarray


def sample_block(lat: Lattices, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> Samples:
    """``keys``: an int64 of each text; ``data``, ``offsets``: its normalised texts (``Lattices.normal``)."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return _sample_block(lat, keys, data, offsets, k, seed)


def _sample_block(lat, keys, data, offsets, k, seed) -> Samples:
    n = len(offsets) - 1
    blank = data == 0x20
    cut = np.zeros(len(data) + 1, bool)
    cut[1 : len(data)] = blank[1:] & ~blank[:-1]
    cut[offsets] = True
    cut = np.flatnonzero(cut)
    starts, ends = cut[:-1], cut[1:]
    if not len(data):
        starts = ends = np.zeros(0, np.int64)
    first, at = lat.states(data, starts, ends), np.searchsorted(starts, offsets)
    seeds = mix(np.asarray(keys, np.int64).view(np.uint64) * _A + np.uint64(seed))
    every, none = np.arange(n), np.zeros(n, np.int64)
    front, paths = _Frontier(n, k), []
    start = every, (none, none, none), np.full(n, -1, np.int32), np.zeros(n), -np.log(-np.log(_uniform(seeds ^ _B))), none, np.full(n, -1)
    for turn in range(k):
        _grow(lat, at, first, seeds, turn, k, *start, paths, front)
        if turn + 1 < k:
            start = _pop(lat, seeds, turn, front, paths)
            if not len(start[0]):
                break
    # A full sample leaves the (k+1)-th value at the top of the frontier; an exhausted one has all there is.
    limit = front.value.max(1, initial=-np.inf)
    found = []
    for rank, p in enumerate(paths):
        logp = np.bincount(np.repeat(np.arange(len(p.text)), np.diff(p.at)), p.logp, minlength=len(p.text)).astype(float)
        found.append((p.text, np.full(len(p.text), rank + 1), logp, p.value, _log_inclusion(logp - limit[p.text])))
    text, rank, logp, value, inclusion = map(np.concatenate, zip(*found))
    order = np.lexsort((rank, text))
    size = np.concatenate([np.diff(p.at) for p in paths])
    begin = np.concatenate([p.at[:-1] + o for p, o in zip(paths, np.cumsum([0, *(len(p.arc) for p in paths)]))])
    arcs = np.concatenate([p.arc for p in paths])[_ranges(begin[order], size[order])]
    ids, n_ids = lat.ids_of(arcs)
    total = np.concatenate([[0], np.cumsum(n_ids, dtype=np.int64)])
    return Samples(text[order], rank[order], logp[order], value[order], inclusion[order], ids, total[np.concatenate([[0], np.cumsum(size[order])])])


def sample_texts(lat: Lattices, keys: list[int], found: list[str], k: int, seed: int = 0) -> list[list[tuple]]:
    """For each text its samples, best first: (ids, log_prob, perturbed value, log_inclusion, normalised text)."""
    data, offsets = lat.normal(*X.column_buffers(pa.array(found, pa.string())))
    s = sample_block(lat, np.array(keys), data, offsets, k, seed)
    out: list[list[tuple]] = [[] for _ in found]
    for i, t in enumerate(s.text.tolist()):
        normal = data[offsets[t] : offsets[t + 1]].tobytes().decode().replace(" ", BLANK)
        out[t].append((s.ids[s.ids_at[i] : s.ids_at[i + 1]], float(s.log_prob[i]), float(s.value[i]), float(s.log_inclusion[i]), normal))
    return out


def _log_inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x)))."""
    return np.where(x > 700, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700))))))


def _sampled(docs: DataFrame, k: int, alpha: float, seed: int, model: str, fields: str, more) -> DataFrame:
    """doc_id, sample, ``fields``, log_prob, perturbed, log_inclusion; more(lat, samples, data, offsets) gives the fields' columns."""
    if k < 1:
        raise ValueError("k is at least 1")
    names = ["doc_id", "sample", *(f.split()[0] for f in fields.split(", ")), "log_prob", "perturbed", "log_inclusion"]

    def run(batches):
        lat = lattices(model, alpha)
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in X.blocks(batch.column(1), BLOCK_BYTES):
                data, offsets = lat.normal(data, offsets)
                s = sample_block(lat, keys[lo:hi], data, offsets, k, seed)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + s.text)), pa.array(s.rank.astype(np.int32)), *more(lat, s, data, offsets), pa.array(s.log_prob), pa.array(s.value), pa.array(s.log_inclusion)], names)

    return texts(docs).mapInArrow(run, f"doc_id long, sample int, {fields}, log_prob double, perturbed double, log_inclusion double")


def sample(docs: DataFrame, k: int = 3, alpha: float = 0.5, seed: int = 0, model: str = MODEL) -> DataFrame:
    """doc_id, sample (from 1, best first), ids, log_prob, perturbed, log_inclusion."""

    def lists(lat, s, data, offsets):
        return (pa.ListArray.from_arrays(pa.array(s.ids_at.astype(np.int32)), pa.array(s.ids.astype(np.int32))),)

    return _sampled(docs, k, alpha, seed, model, "ids array<int>", lists)


def sample_digests(docs: DataFrame, k: int = 3, alpha: float = 0.5, seed: int = 0, model: str = MODEL) -> DataFrame:
    """As ``sample``, but n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and decodes (to the normalised text) for ids."""

    def digests(lat, s, data, offsets):
        blob = memoryview(s.ids.astype("<u4").tobytes())
        at = s.ids_at.tolist()
        crc = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
        size = lat.raw_len[s.ids]
        plain = memoryview(lat.raw[_ranges(lat.raw_at[s.ids], size)].tobytes())
        total = np.concatenate([[0], np.cumsum(size)])[s.ids_at].tolist()
        text, own = memoryview(data.tobytes()), offsets.tolist()
        same = [plain[a:b] == text[own[t] : own[t + 1]] for a, b, t in zip(total[:-1], total[1:], s.text.tolist())]
        return pa.array(np.diff(s.ids_at)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())

    return _sampled(docs, k, alpha, seed, model, "n_tokens long, ids_crc32 long, decodes boolean", digests)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids: the library's own (best) segmentation."""

    def run(batches):
        sp = lattices(model, 1.0).sp
        for batch in batches:
            ids = sp.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids): the library's decoding; null ids are an empty text."""

    def run(batches):
        sp = lattices(model, 1.0).sp
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x) if x else "" for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
