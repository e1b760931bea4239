"""Sharing one text out over several cues, as Column folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ends_with_mark, let, trim_ws


def tokens_of(text, no_space: Column) -> Column:
    """Words of a text, or its characters for scripts written without spaces."""
    t = trim_ws(text)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    return F.when(no_space, chars).otherwise(words)


def distribute_text(text, weights, no_space: Column) -> Column:
    """Split a text into size(weights) consecutive parts, sized by the weights.

    Every part gets a token while there are enough of them, and a cut moves by up to two
    tokens to fall behind punctuation. The fold carries the last cut, so it is linear in the
    number of parts.
    """
    given = weights if isinstance(weights, Column) else F.col(weights)
    state = F.struct(given.alias("w"), tokens_of(text, no_space).alias("toks"), trim_ws(text).alias("t"),
                     no_space.alias("solid"))
    return let(state, _distributed)


def _distributed(s0: Column) -> Column:
    w, toks, no_space = s0["w"], s0["toks"], s0["solid"]
    count, n = F.size(w), F.size(toks)
    total = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + x)
    total = F.when(total == 0, count.cast("bigint")).otherwise(total)
    start = F.struct(
        F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("last"),
        F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("k"))

    def step(s, x):
        run = s["run"] + x
        k = s["k"] + 1
        ideal = F.bround(n * run / total, 0).cast("int")
        lower = s["last"] + 1
        upper = n - (count - k)
        want = F.least(F.greatest(ideal, lower), upper)
        snapped = F.lit(None).cast("int")
        for off in (2, -2, 1, -1, 0):
            c = want + off
            good = (c >= lower) & (c <= upper) & ends_with_mark(F.get(toks, c - 1))
            snapped = F.when(good, c).otherwise(snapped)
        cut = F.when(lower > upper, F.least(F.greatest(ideal, s["last"]), n)).otherwise(
            F.coalesce(snapped, want))
        return F.struct(F.array_append(s["cuts"], cut).alias("cuts"), cut.alias("last"),
                        run.alias("run"), k.alias("k"))

    cuts = F.aggregate(F.slice(w, F.lit(1), F.greatest(count - 1, F.lit(0))), start, step, lambda s: s["cuts"])
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(n))

    def part(edges, i):
        lo, hi = F.element_at(edges, i), F.element_at(edges, i + 1)
        piece = F.slice(toks, lo + 1, F.greatest(hi - lo, F.lit(0)))
        return trim_ws(F.when(no_space, F.array_join(piece, "")).otherwise(F.array_join(piece, " ")))

    return F.when(count <= 1, F.array(s0["t"])).otherwise(let(edges, lambda e: F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: part(e, i))))


def spread_parts(members: Column, parts: Column) -> Column:
    """Pair parts with the cues they came from: array<struct<id,start,end,text,part>>.

    A cue whose part is empty lends its end to the cue before it; the first part that holds
    text starts where the unit starts.
    """
    n = F.size(members)
    kept = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(parts, i) != "")

    def one(i, j):
        own = F.element_at(members, i)
        until = F.coalesce(F.get(kept, j + 1) - 1, n)
        return F.struct(
            own["id"].alias("id"),
            F.when(j == 0, F.element_at(members, 1)["start"]).otherwise(own["start"]).alias("start"),
            F.element_at(members, until)["end"].alias("end"),
            own["text"].alias("original"),
            F.element_at(parts, i).alias("translated"))

    return F.transform(kept, one)
