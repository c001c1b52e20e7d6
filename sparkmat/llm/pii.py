"""Personal data and secrets by candidate gradient boosting, in built-in Spark functions only.

High-recall generators (``GENERATORS``; the base patterns are among them) propose overlapping spans with
their format and the characters around them, in one pass over the texts. Base candidates that pass their
kind's check are always spans. Boosted trees of depth 2, one ensemble per kind, learn from all rows which
formats and contexts go with checked spans: base spans are the positive examples, candidates that fail
their check and meet no base span the negative ones (addresses are checked in plain form, so obfuscated
and spaced ones are neither). No feature says what the check says (digits, check sums, ranges): trees see
shape, separators and surroundings, so they score a candidate as what its place makes of it, and candidates
that no check decides, or that fail one in a place where checked spans stand, can be selected.

The kind ``secret`` has no contract pattern: values assigned to a name such as token or password are its base,
long mixed words anywhere else its other candidates; trees learn the shape of the values without the name. Its
unnamed candidates are negative examples only for want of better ones, so its threshold asks for ``NAMED`` of a shape's
examples to be named, less than ``precision``.

Features are small integers, so what reaches the driver is a count per distinct feature row. A third of the
documents (by hash) calibrates the score (Platt) and picks the least threshold with ``precision``; candidates
that no base span of their kind overlaps and that reach it are added. Without examples of both classes a
kind adds nothing.

Null texts are empty. Offsets are code points, ends exclusive. Spans of different kinds may overlap.
Rows that repeat a doc_id, or have none, are each searched. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmat.llm._spark import stage, texts

#: The kinds of the base digest come first.
KINDS = ["email", "ip", "card", "phone", "secret"]
N_BASE = 4
#: Share of named ones among the examples that a selected shape of a secret needs.
NAMED = 0.9
_RUN = r"[A-Za-z0-9._%+-]"
#: kind, whether it is the kind's base pattern, a plain string every match holds (or ''), pattern. Possessive
#: repeats and the look-behinds give the same leftmost matches as the plain patterns, without backtracking.
GENERATORS = [
    ("email", True, "@", rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"),
    ("phone", True, "+", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, "@", rf"(?<!{_RUN}){_RUN}{{1,64}} ?@ ?[A-Za-z0-9-]{{1,63}}+(?: ?\. ?[A-Za-z0-9-]{{1,63}}+){{0,8}}+"),
    ("email", False, "", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]{1,63}){1,8}"),
    ("ip", False, ".", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("card", False, "", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("card", False, "", r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", False, "+", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"),
    ("phone", False, "", r"(?<![0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("secret", True, "", r"(?i)(?:pass(?:word|wd|phrase)|secret|token|credential|(?:api|access|private|auth)[ _-]?key)s?[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^\s\"',;]{8,}+"),
    ("secret", False, "", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]{0,64}[0-9])(?=[0-9_/+=-]{0,64}[A-Za-z])[A-Za-z0-9_/+=-]{16,}+"),
]
CONTEXT = 24
_HINT = {"email": r"(?i)mail|contact|write|reply", "ip": r"(?i)\bip\b|host|addr|server", "card": r"(?i)card|visa|master|pay|credit", "phone": r"(?i)tel|phone|call|fax|mobile", "secret": r"(?i)http|www|sha|md5|commit|uuid|file"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FEATURES = ["length", "groups", "separator", "even", "share", "distinct", "before", "after", "word", "hint"]
CANDIDATE = "array<struct<g:int,s:bigint,e:bigint,m:string,l:string,r:string>>"
_CHUNK = 256


def prefix_sums(a: Column) -> Column:
    """Exclusive running sums of an array of longs, in chunks so that long arrays stay near linear."""
    zero = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")), lambda c: F.slice(a, c * _CHUNK + 1, F.lit(_CHUNK)))

    def run(x: Column) -> Column:
        start = F.struct(zero.alias("t"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["t"] + v).alias("t"), F.array_append(acc["o"], acc["t"]).alias("o")), lambda acc: acc["o"])

    base = run(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda t, v: t + v)))
    return F.flatten(F.zip_with(chunks, base, lambda c, b: F.transform(run(c), lambda v: v + b)))


def _candidate(g: int):
    return lambda x: F.struct(F.lit(g).alias("g"), (x["p"] + x["w"]).alias("s"), (x["p"] + x["w"] + x["z"]).alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))


def candidates(text: Column) -> Column:
    """All generators' matches with offsets and contexts (``CANDIDATE``)."""
    out = []
    for g, (_, _, needs, pattern) in enumerate(GENERATORS):
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        n = F.size(found)
        gap = F.transform(F.slice(between, 1, n), lambda x: F.length(x).cast("long"))
        size = F.transform(found, lambda x: F.length(x).cast("long"))
        before = prefix_sums(F.zip_with(gap, size, lambda a, b: a + b))
        left = F.transform(F.slice(between, 1, n), lambda x: F.right(x, F.lit(CONTEXT)))
        right = F.transform(F.slice(between, 2, n), lambda x: F.left(x, F.lit(2)))
        # Where the text between two matches is shorter than a context, the context is what there is of it.
        rows = F.transform(F.arrays_zip(found.alias("m"), before.alias("p"), gap.alias("w"), size.alias("z"), left.alias("l"), right.alias("r")), _candidate(g))
        may = F.contains(text, F.lit(needs)) & F.regexp_like(text, F.lit(pattern)) if needs else F.regexp_like(text, F.lit(pattern))
        out.append(F.when(may, rows).otherwise(F.array().cast(CANDIDATE)))
    return F.concat(*out)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False))


def _plain(m: Column) -> Column:
    """An address without obfuscation: [at] and (dot) as signs, no blanks around '@' or on both sides of a dot."""
    m = F.regexp_replace(F.regexp_replace(m, r"(?i) ?[\[(]at[\])] ?", "@"), r"(?i) ?[\[(]dot[\])] ?", ".")
    return F.regexp_replace(F.regexp_replace(m, " ?@ ?", "@"), r" \. ", ".")


def _address(m: Column) -> Column:
    return F.regexp_like(_plain(m), F.lit(rf"^{_RUN}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))


def _value(m: Column) -> Column:
    """A secret without the name it is assigned to."""
    return F.regexp_replace(m, r"(?i)^(?:pass|secret|token|credential|api|access|private|auth)[A-Za-z _-]*[\"']?[ \t]*[:=][ \t]*[\"']?", "")


def checked(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {"email": _address(m), "ip": F.regexp_like(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), "card": n.between(16, 19) & _luhn(m), "phone": n.between(8, 15), "secret": F.regexp_like(m, F.lit("[:=]")) & F.regexp_like(_value(m), F.lit("[0-9]"))}[kind]


def of_kind(c: Column, kind: str, base: bool | None = None) -> Column:
    which = [g for g, x in enumerate(GENERATORS) if x[0] == kind and base in (None, x[1])]
    return F.filter(c, lambda x: x["g"].isin(which))


def _char_class(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(F.regexp_like(c, F.lit(r"^\s$")), 1).when(F.regexp_like(c, F.lit(r"^[0-9]$")), 2).when(F.regexp_like(c, F.lit(r"^\p{L}$")), 3).when(F.regexp_like(c, F.lit(r"^[.+@-]$")), 4).otherwise(5)


def features(kind: str, x: Column) -> dict[str, Column]:
    """Small integers of a candidate's shape and surroundings; none of them repeats ``checked``."""
    m = _plain(x["m"]) if kind == "email" else _value(x["m"]) if kind == "secret" else F.regexp_replace(x["m"], r"^\+", "")
    size = F.greatest(F.length(m), F.lit(1))
    marks = F.regexp_replace(m, "[A-Za-z0-9]+", "")
    first = F.left(marks, F.lit(1))
    # A secret's name stands in its left context or in the match: neither is shown.
    left = F.when(F.lit(kind == "secret"), F.lit("")).otherwise(x["l"])
    end = F.rtrim(left)
    last = F.right(end, F.lit(1))
    return {
        "length": F.least(F.floor(size / (2 if kind == "secret" else 4)), F.lit(24)).cast("int"),
        "groups": F.least(F.length(marks), F.lit(8)),
        "separator": F.when(first == "", 0).when(first == " ", 1).when(first == "-", 2).when(first == ".", 3).when(first == "@", 4).otherwise(5),
        "even": F.regexp_like(m, F.lit(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$")).cast("int"),
        "share": F.floor(F.length(_digits(m)) * 8 / size).cast("int"),
        "distinct": F.floor(F.size(F.array_distinct(F.split(F.left(F.lower(m), F.lit(64)), ""))) / 4).cast("int"),
        "before": F.lit(0) if kind == "secret" else _char_class(F.right(x["l"], F.lit(1))),
        "after": F.lit(0) if kind == "secret" else _char_class(F.left(x["r"], F.lit(1))),
        "word": F.when(last == "", 0).when(F.regexp_like(last, F.lit("[:=>]")), 1).when(F.regexp_like(last, F.lit("[0-9]")), 2).when(F.regexp_like(end, F.lit(r"\p{L}{2}$")), 3).otherwise(4),
        "hint": F.regexp_like(x["l"], F.lit(_HINT[kind])).cast("int"),
    }


@dataclass
class Boosted:
    """A calibrated sum of depth-2 trees: (f, t, (fl, tl, a, b), (fr, tr, c, d)); left is feature <= t."""

    trees: list = field(default_factory=list)
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, left, right in self.trees:
            for side, (g, u, a, b) in ((x[:, f] <= t, left), (x[:, f] > t, right)):
                out += np.where(side, np.where(x[:, g] <= u, a, b), 0)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.intercept, -30, 30)))

    def column(self, f: dict[str, Column]) -> Column:
        out = F.lit(0.0)
        for i, t, (l, tl, a, b), (r, tr, c, d) in self.trees:
            out = out + F.when(f[FEATURES[i]] <= t, F.when(f[FEATURES[l]] <= tl, a).otherwise(b)).otherwise(F.when(f[FEATURES[r]] <= tr, c).otherwise(d))
        return 1 / (1 + F.exp(-(out * self.slope + self.intercept)))


def _split(x, g, h, weight=1.0):
    """Best (gain, feature, threshold, left value, right value) of a stump on gradients."""
    value = lambda a, b: a / (b + weight)
    every = value(g.sum(), h.sum())
    best = (0.0, 0, float(x[:, 0].max(initial=0)), every, every)  # no split: one value, whatever the feature
    whole = g.sum() ** 2 / (h.sum() + weight)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            m = x[:, f] <= t
            a, b, c, d = g[m].sum(), h[m].sum(), g[~m].sum(), h[~m].sum()
            gain = a * a / (b + weight) + c * c / (d + weight) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, float(t), value(a, b), value(c, d))
    return best


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, rounds: int = 24, rate: float = 0.3, precision: float = 0.99) -> Boosted:
    """Logistic boosting on weighted feature rows; ``held`` rows calibrate."""
    model, z = Boosted(), np.zeros(len(x))
    learn = ~held
    if not (len(x) and len({*y[learn]}) == 2):
        return model
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = (w * (y - p))[learn], (w * p * (1 - p))[learn]
        _, f, t, _, _ = _split(x[learn], g, h)
        parts = []
        for m in (x[learn][:, f] <= t, x[learn][:, f] > t):
            _, i, u, a, b = _split(x[learn][m], g[m], h[m]) if m.any() else (0, 0, 0.0, 0.0, 0.0)
            parts.append((i, u, float(rate * a), float(rate * b)))
        model.trees.append((f, t, *parts))
        for side, (i, u, a, b) in ((x[:, f] <= t, parts[0]), (x[:, f] > t, parts[1])):
            z += np.where(side, np.where(x[:, i] <= u, a, b), 0)
    test = held if len({*y[held]}) == 2 else learn
    s, i = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        q = 1 / (1 + np.exp(-(s * z[test] + i)))
        r = w[test] * (y[test] - q) / w[test].sum()
        s, i = s + float((r * z[test]).sum()), i + float(r.sum())
    model.slope, model.intercept = s, i
    q = model.score(x[test])
    for t in np.unique(q):
        m = q >= t
        if (w[test] * y[test])[m].sum() >= precision * w[test][m].sum():
            model.threshold = max(float(t) - 1e-9, 0.5)
            break
    return model


def _apart(x: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _base(c: Column, kind: str) -> Column:
    return F.filter(of_kind(c, kind, True), lambda x: checked(kind, x["m"]))


def _digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def search(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, its candidates and on request the text's digest, written once: nothing after it reads a text."""
    more = [_digest_of(F.col("text")).alias("digest")] if digests else []
    return stage(texts(docs).select("doc_id", *more, candidates(F.coalesce("text", F.lit(""))).alias("c")), "candidates")


def learn(found: DataFrame, precision: float = 0.99) -> dict[str, Boosted]:
    held = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) == 0).alias("held")
    out = {}
    some = found.where(F.size("c") > 0)
    for kind in KINDS:
        base = some.select(held, of_kind(F.col("c"), kind).alias("c"), _base(F.col("c"), kind).alias("b"))
        one = base.select("held", "b", F.explode("c").alias("x"))
        same = F.exists("b", lambda b: (b["s"] == F.col("x")["s"]) & (b["e"] == F.col("x")["e"]))
        label = F.when(same, 1).when(~checked(kind, F.col("x")["m"]) & _apart(F.col("x"), F.col("b")), 0)
        rows = one.select("held", label.alias("y"), *(v.alias(k) for k, v in features(kind, F.col("x")).items())).where("y is not null").groupBy("held", "y", *FEATURES).count().orderBy("held", "y", *FEATURES).collect()
        a = np.array([[int(v) for v in r] for r in rows], float).reshape(len(rows), len(FEATURES) + 3)
        out[kind] = boost(a[:, 2:-1], a[:, 1], a[:, -1], a[:, 0] > 0, precision=min(precision, NAMED) if kind == "secret" else precision)
    return out


def _only(i: int):
    return lambda b: b["k"] == i


def _accepted(kind: str, i: int, model: Boosted):
    mine = F.filter("base", _only(i))
    return lambda x: _apart(x, mine) & (model.column(features(kind, x)) >= model.threshold)


def spans(found: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """doc_id, base and spans: arrays of (k, s, e, m) in order of kind, start and end."""
    pack = lambda i, a: F.transform(a, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    base = F.concat(*(pack(i, _base(F.col("c"), k)) for i, k in enumerate(KINDS)))  # checked secrets among them
    keys = [c for c in found.columns if c != "c"]
    rows = found.select(*keys, "c", base.alias("base"))
    more = []
    for i, kind in enumerate(KINDS):
        model = models[kind]
        if model.trees and model.threshold <= 1:
            more.append(pack(i, F.filter(of_kind(F.col("c"), kind, False), _accepted(kind, i, model))))
    every = F.array_sort(F.array_distinct(F.concat("base", *more)))
    return rows.select(*keys, "base", F.when(F.size("c") == 0, F.col("base")).otherwise(every).alias("spans"))


def digest(a: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of these four kinds), spans, n_secret, n_added and n_spans (all)."""
    found = search(docs)
    out = spans(found, learn(found))
    count = lambda a, k: F.size(F.filter(a, k)).cast("long")
    contract = F.filter("base", lambda b: b["k"] < N_BASE)
    counts = [count("base", _only(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:N_BASE])]
    more = [count("spans", _only(N_BASE)).alias("n_secret"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(digest(contract), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's characters in ``text`` replaced by its kind in brackets; overlapping spans become one.

    Rows find their spans by doc_id and the text's digest, so null and repeated doc_ids get those of their own text.
    """
    found = search(docs, digests=True)
    some = stage(spans(found, learn(found)).where(F.size("spans") > 0).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "spans").dropDuplicates(["_doc", "_digest"]), "redactions")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["at"], x["s"])
        piece = F.concat(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int")), F.when(x["s"] >= acc["at"], F.element_at(names, x["k"] + 1)).otherwise(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.array_append(acc["o"], piece).alias("o"))

    order = F.array_sort("spans", lambda a, b: F.when(a["s"] != b["s"], F.signum(a["s"] - b["s"])).otherwise(F.signum(b["e"] - a["e"])).cast("int"))
    new = F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["o"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.join(some, docs["doc_id"].eqNullSafe(some["_doc"]) & (_digest_of(docs["text"]) == some["_digest"]), "left")
    return joined.select(*(F.when(F.col("spans").isNotNull(), new).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns))
