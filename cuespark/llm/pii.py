"""Personal data by weak supervision, in SQL functions.

Patterns find candidate spans. Labelers (a strict pattern, a gazetteer, the words before, the shape)
each vote for or against a candidate or abstain; expectation-maximisation over counted vote patterns
estimates how reliable each is; the posteriors train a logistic span classifier on the span's
features, and that decides about the candidates that no base pattern has found. Base spans stay.

Votes and features of a span are one number, so what leaves the executors is a count for each of at
most a few thousand patterns. The classifier is a sum of literals and runs inside the row: texts
are mapped, never shuffled, and no span is regrouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import free_name, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base patterns. Written so that Java's matcher neither recurses nor tries a run of characters
# from each of its positions: a match starts where the last one ended or where the run starts, and
# groups are possessive where nothing after them could take a character back.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PROBE = {"email": "@", "phone": "+"}          # texts without the character have no match
# Wider patterns for what the base ones miss, one per kind; as long as the value is, and possessive like the base ones.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++"
             r"(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api_key|apikey)\x20{0,3}[=:]\x20{0,3}\"?[A-Za-z0-9_+/=.-]{12,}+\"?",
}
_WIDE_PROBE = {"email": "(?i)[\\[(](?:at)[\\])]", "secret": "(?i)(?:token|secret|passw|api_?key)"}

# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov io de fr es uk eu info biz co us".split()
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": "mail contact write address correo courriel",
    "ip": "ip host server address login",
    "card": "card visa mastercard amex credit pay number karte tarjeta carte",
    "phone": "phone tel call mobile fax number telefon movil portable",
    "secret": "key token secret password auth login",
}
BEFORE = 24             # characters before a span that are looked at
VOTERS = 4
FEATURES = 6


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """start, end, piece of every match of a pattern, leftmost first, without overlap (code points)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,piece:string>>)")

    def step(gap_list, matches):
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def add(s, k):
            start = s["at"] + F.length(F.get(gap_list, k))
            end = start + F.length(F.get(matches, k))
            one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.get(matches, k).alias("piece")))
            return F.struct(end.alias("at"), F.concat(s["out"], one).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add, lambda s: s["out"])

    def with_matches(m):
        return F.when(F.size(m) == 0, empty).otherwise(F.get(F.transform(F.array(gaps), lambda g: step(g, m)), F.lit(0)))

    return F.get(F.transform(F.array(found), with_matches), F.lit(0))


def digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(piece: Column) -> Column:
    """Whether the digits of a piece pass the Luhn check."""
    places = F.transform(F.split(F.reverse(digits(piece)), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
                        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"


def valid(kind: str, piece: Column) -> Column:
    n = F.length(digits(piece))
    if kind == "ip":
        return piece.rlike(_IP)
    if kind == "card":
        return n.between(14, 19) & luhn(piece)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: valid(kind, s["piece"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _gated(text: Column, pattern: str, kind: str, gate: Column | None) -> Column:
    found = spans_of(text, pattern, kind)
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,piece:string>>)")
    return found if gate is None else F.when(gate, found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then by kind."""
    parts = []
    for kind, pattern in _BASE.items():
        gate = F.contains(text, F.lit(_PROBE[kind])) if kind in _PROBE else text.rlike("[0-9]")
        parts.append(F.filter(_gated(text, pattern, kind, gate), _valid_span(kind)))
    return ordered(F.concat(*parts))


def ordered(spans: Column) -> Column:
    """Sorted by start, then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"),
                                                  s["kind"].alias("kind"), s["piece"].alias("piece")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                               s["end"].alias("end"), s["piece"].alias("piece")))


def wide_spans(text: Column, base: Column) -> Column:
    """Candidates of the wider patterns that overlap no base span."""
    parts = []
    for kind, pattern in _WIDE.items():
        gate = text.rlike(_WIDE_PROBE[kind]) if kind in _WIDE_PROBE else text.rlike("[0-9]")
        parts.append(_gated(text, pattern, kind, gate))
    return F.filter(F.concat(*parts), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _by_kind(kind: Column, of) -> Column:
    out = None
    for k in KINDS:
        out = F.when(kind == k, of(k)) if out is None else out.when(kind == k, of(k))
    return out


def _votes(span: Column, text: Column, strict: Column) -> list[Column]:
    kind, piece = span["kind"], span["piece"]
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] - BEFORE + 1),
                                 F.least(F.lit(BEFORE), span["start"])))
    top = F.lower(F.regexp_extract(piece, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    gazetteer = _by_kind(kind, lambda k: {
        "email": weak.vote(top.isin(TOP_DOMAINS), F.length(top) < 2),
        "ip": weak.vote(~piece.rlike(r"^(?:0|127|255)\."), piece.rlike(r"^(?:0+\.){4}")),
        "card": weak.vote(digits(piece).rlike(CARD_PREFIXES), digits(piece).rlike("^0")),
        "phone": weak.vote(piece.rlike(CALLING_CODES) | piece.rlike(r"^\(?[2-9][0-9]{2}"), piece.rlike(r"^\+?0{3}")),
        "secret": weak.vote(piece.rlike("[0-9]") & piece.rlike("[A-Za-z]"), ~piece.rlike("[0-9]")),
    }[k])
    context = _by_kind(kind, lambda k: F.when(before.rlike(rf"\b(?:{'|'.join(CONTEXT[k].split())})\b"), weak.GOOD).otherwise(weak.ABSTAIN))
    # a run of equal digits, or a piece inside a longer word or number, is seldom personal
    after = F.substring(text, span["end"] + 1, F.lit(1))
    shape = weak.vote(~after.rlike(r"^[A-Za-z0-9_]"), piece.rlike(r"([0-9])\1{7}") | after.rlike(r"^[0-9_]"))
    return [F.when(strict, weak.GOOD).otherwise(weak.BAD), gazetteer, context, shape]


def _features(span: Column) -> list[Column]:
    piece, n = span["piece"], F.length(span["piece"])
    return [piece.rlike(r"[\x20]"), piece.rlike(r"[.()-]"), n > 20, F.length(digits(piece)) * 2 > n,
            piece.rlike("[A-Za-z]"), piece.rlike(r"[=:\"\[(]")]


def _coded(span: Column, text: Column, strict: Column) -> Column:
    """Kind, votes and features of a span as one number."""
    kind = _by_kind(span["kind"], lambda k: F.lit(KINDS.index(k)))
    total = kind
    for v in _votes(span, text, strict):
        total = total * 3 + v
    for f in _features(span):
        total = total * 2 + f.cast("int")
    return total.cast("long")


def _decoded(value: int) -> tuple[int, tuple[int, ...], list[int]]:
    bits = []
    for _ in range(FEATURES):
        value, b = divmod(value, 2)
        bits.append(b)
    kind, votes = divmod(value, 3 ** VOTERS)
    return kind, weak.decode(votes, VOTERS), bits[::-1]


def _inputs(kind: int, votes, bits) -> list[float]:
    """Classifier inputs: kind, features, and the votes of the labelers other than the strict pattern."""
    x = [1.0] + [float(kind == k) for k in range(len(KINDS))] + [float(b) for b in bits]
    for v in votes[1:]:
        x += [float(v == weak.GOOD), float(v == weak.BAD)]
    return x


def train(patterns: list[tuple[int, int]], rounds: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> dict[int, float]:
    """Probability of being personal data for each pattern number, from counted patterns.

    EM runs for each kind over its vote patterns; its posteriors are the labels of the classifier,
    fitted by gradient descent over the pattern table.
    """
    rows = [(value, *_decoded(value), n) for value, n in sorted(patterns)]
    soft = {}
    for kind in range(len(KINDS)):
        own = [(votes, n) for _, k, votes, _, n in rows if k == kind]
        if own:
            r = weak.estimate(own, VOTERS, prior=0.7, on_positive=0.85, on_negative=0.3, smoothing=20.0)
            soft.update({(kind, votes): r.posterior(votes) for votes, _ in own})
    if not rows:
        return {}
    xs = [_inputs(k, votes, bits) for _, k, votes, bits, _ in rows]
    ys = [soft[k, votes] for _, k, votes, _, _ in rows]
    ns = [math.sqrt(row[-1]) for row in rows]           # frequent patterns shall not drown the rest
    total, w = sum(ns), [0.0] * len(xs[0])

    def probability(x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))

    for _ in range(rounds):
        slope = [penalty * a for a in w]
        for x, y, n in zip(xs, ys, ns):
            e = n * (probability(x) - y) / total
            for i, a in enumerate(x):
                if a:
                    slope[i] += e * a
        w = [a - rate * 4 * b for a, b in zip(w, slope)]
    return {row[0]: probability(x) for row, x in zip(rows, xs)}


def find(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents' columns and base, spans: arrays of (kind, start, end, piece), positions in code points.

    spans holds the base spans and those candidates whose probability is at least `least` (of
    overlapping ones the first), by start and then by kind. A null text is empty: no spans. Repeated
    rows are judged each and each count in training. A result replaces an input column of its name.
    Without any candidate nothing is trained and nothing added.
    """
    t, wide = text_of(text), free_name(docs, "wide")

    def candidates(df: DataFrame) -> DataFrame:
        d = df.withColumn("base", base_spans(text_of(text)))
        return d.withColumn(wide, wide_spans(text_of(text), F.col("base")))

    def coded(column: str, strict: bool) -> Column:
        return F.transform(column, lambda s: _coded(s, t, F.lit(strict)))

    both = F.concat(coded("base", True), coded(wide, False))
    counts = (candidates(docs.select(text)).where(F.size("base") + F.size(wide) > 0)
              .select(F.explode(both).alias("code")).groupBy("code").count().collect())
    p = train([(r["code"], r["count"]) for r in counts])
    chosen = [F.lit(c) for c, x in p.items() if x >= least]
    d = candidates(docs)
    if not chosen:
        return d.withColumn("spans", F.col("base")).drop(wide)
    accepted = F.array(*chosen)
    added = F.filter(wide, lambda s: F.array_contains(accepted, _coded(s, t, F.lit(False))))
    # of overlapping additions the first stays
    apart = F.aggregate(ordered(added), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,piece:string>>)"),
                        lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > s["start"]), a)
                        .otherwise(F.concat(a, F.array(s))))
    return d.withColumn("spans", F.when(F.size(wide) == 0, F.col("base")).otherwise(ordered(F.concat("base", apart)))).drop(wide)


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(doc, *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s, x):
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        new = F.struct(x["end"].alias("at"), F.concat(s["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] < s["at"], longer).otherwise(new)

    rest = F.aggregate(spans, zero, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(rest)


def mask(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all kept, with personal data in the text replaced; own columns only."""
    names = {c: free_name(docs, f"own_{c}") for c in ("base", "spans") if c in docs.columns}      # results would replace them
    found = find(docs.withColumnsRenamed(names), text, **options)
    found = found.withColumn(text, masked(F.col(text), F.col("spans")))
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
