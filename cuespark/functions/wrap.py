"""Line wrapping as Column expressions (array functions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import collapse, ends_with_mark, let


def _even_pieces(text: Column, limit: Column) -> Column:
    """Cut unbroken text into equally sized pieces of at most `limit` characters."""
    n = F.length(text)
    count = F.greatest(F.ceil(n / limit), F.lit(1))
    size = F.greatest(F.ceil(n / count), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), size)
    return F.transform(starts, lambda s: F.substr(text, s, size))


def _two_lines(words: Column, limit: Column, total: Column) -> Column:
    """The best even split into two lines that both fit, or null when there is none."""
    def scored(k):
        top = F.array_join(F.slice(words, F.lit(1), k), " ")
        a = F.length(top)
        b = total - a - 1
        score = (F.abs(a - b).cast("double")
                 - F.when(ends_with_mark(F.element_at(words, k), ".,?!;:"), limit * 0.25).otherwise(0.0)
                 + F.when(a > b, 2.0).otherwise(0.0))
        return F.struct(score.alias("score"), k.alias("k"), a.alias("a"), b.alias("b"))

    ks = F.sequence(F.lit(1), F.size(words) - 1)
    fits = F.filter(F.transform(ks, scored), lambda s: (s["a"] <= limit) & (s["b"] <= limit))
    k = F.array_min(fits)["k"]
    return F.when(k.isNotNull(), F.array(
        F.array_join(F.slice(words, F.lit(1), k), " "),
        F.array_join(F.slice(words, k + 1, F.size(words)), " ")))


def _greedy(words: Column, limit: Column, whole_words: bool) -> Column:
    """Fill lines word by word; a word longer than a line is cut into even pieces, or has a line of its own."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def step(s, w):
        joined = F.when(s["cur"] == "", w).otherwise(F.concat(s["cur"], F.lit(" "), w))
        flushed = F.when(s["cur"] == "", s["lines"]).otherwise(F.array_append(s["lines"], s["cur"]))
        pieces = F.array(w) if whole_words else _even_pieces(w, limit)
        fits = F.length(joined) <= limit
        long = F.length(w) > limit
        return F.struct(
            F.when(fits, s["lines"])
            .when(long, F.concat(flushed, F.slice(pieces, F.lit(1), F.size(pieces) - 1)))
            .otherwise(flushed).alias("lines"),
            F.when(fits, joined).when(long, F.element_at(pieces, -1)).otherwise(w).alias("cur"))

    def finish(s):
        return F.when(s["cur"] == "", s["lines"]).otherwise(F.array_append(s["lines"], s["cur"]))

    return F.aggregate(words, start, step, finish)


def wrap_text(text, max_len=K.MAX_LINE_LENGTH, max_lines: int = K.MAX_LINES, whole_words: bool = False) -> Column:
    """Display lines of a cue as array<string>. `max_len` may be a number or a Column.

    One line if it fits, an unbroken text in even pieces, two balanced lines when that
    fits, else greedily filled lines. No word is ever dropped. With `whole_words` none is cut
    either, however long, so the lines joined by spaces are the text again.
    """
    limit = max_len if isinstance(max_len, Column) else F.lit(max_len)

    def lines(s):
        t, words, limit = s["t"], s["words"], s["limit"]
        n = F.length(t)
        many = _greedy(words, limit, whole_words)
        if max_lines >= 2:
            many = F.when(n <= limit * 2 + 1, F.coalesce(_two_lines(words, limit, n), many)).otherwise(many)
        return (F.when(n == 0, F.array().cast("array<string>"))
                .when(n <= limit, F.array(t))
                .when(F.size(words) == 1, F.array(t) if whole_words else _even_pieces(t, limit))
                .otherwise(many))

    return let(collapse(text), lambda t: let(
        F.struct(t.alias("t"), F.split(t, " ").alias("words"), limit.alias("limit")), lines))
