"""Quality rules as weak supervision: rules vote or abstain, and a document is kept by the
posterior of a model that knows how reliable each rule is, not by passing every rule.

All measures are SQL functions over a whole text; the repeated windows of a text are found by
sorting window hashes within the row. One aggregate counts vote patterns for the estimation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import weak
from .common import free_name, text_of, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# What a rule is taken for beforehand (it passes 98 % of good and 80 % of bad documents: each rule
# sees one kind of fault) weighs as much as the votes of this share of the documents.
TRUST = 0.3
BLANK_CHARS = " \t\n\x0b\x0c\r"

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = ("the of and to in is that with a for la le les de des et un une que en el los las y por der die das "
                  "und den von mit ist zu").split()


def removed(text: Column, chars: str) -> Column:
    """Number of characters of `text` that are among `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def let(value: Column, use) -> Column:
    """use(value) with `value` computed once for the row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(word_hashes: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows that occur more than once in the row's array of word hashes.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only a text in which some
    window repeats is sorted.
    """
    def window_hash(i):
        return F.xxhash64(*[F.get(word_hashes, i + k) for k in range(size)])

    def covered(pairs):             # sorted (hash, position): equal hashes stand together
        def repeated(x, k):
            return F.when((x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["i"])

        at = F.sort_array(F.filter(F.transform(pairs, repeated), lambda x: x.isNotNull()))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
            (s["n"] + F.least(F.lit(size), x + size - s["end"])).alias("n"), (x + size).alias("end")), lambda s: s["n"])

    def by_hash(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    n = F.size(word_hashes)
    hashes = F.transform(F.sequence(F.lit(0), n - size), window_hash)
    return F.when(n < size, F.lit(0)).otherwise(let(hashes, by_hash)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    what the rules look at. Null texts count as empty."""
    t = text_of(text)
    word, line, h = (free_name(docs, n) for n in ("words", "lines", "hashes"))
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    made = {
        "n_words": F.size(h).cast("long"),
        "word_chars": (F.length(t) - removed(t, BLANK_CHARS)).cast("long"),
        "n_symbols": removed(t, SYMBOLS),
        "n_lines": F.size(line).cast("long"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
        "n_repeat_words": repeated_words(F.col(h)),
        "n_bare": F.size(F.filter(word, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long"),
        "n_stops": removed(t, ".?!…。"),
        "n_shouts": removed(t, "!"),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
        "n_letters": (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long"),
        "has_function_word": t.rlike(rf"(?i)\b(?:{'|'.join(FUNCTION_WORDS)})\b"),
    }
    d = docs.withColumns({word: words(text), line: lines}).withColumn(
        h, F.transform(word, lambda x: F.xxhash64(x)))
    return d.withColumns(made).drop(word, h, line)


def votes() -> list[Column]:
    """The rules: each votes good or bad on a measured document, or abstains."""
    w, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))

    def share(name, of):
        return F.col(name) / F.greatest(of, F.lit(1))

    mean = F.col("word_chars") / F.greatest(w, F.lit(1))
    stops = w / F.greatest(F.col("n_stops"), F.lit(1))
    return [
        weak.vote(w >= 20, w < 10),
        weak.vote(mean.between(3, 10), ~mean.between(2, 15)),
        weak.vote(share("n_symbols", w) < 0.02, share("n_symbols", w) > 0.1),
        weak.vote((F.col("n_lines") > 1) & (share("n_dup_lines", F.col("n_lines")) < 0.05),
                  share("n_dup_lines", F.col("n_lines")) > 0.3),
        weak.vote(share("n_repeat_words", w) < 0.05, share("n_repeat_words", w) > 0.2),
        weak.vote(share("n_upper", F.col("n_letters")) < 0.2, share("n_upper", F.col("n_letters")) > 0.5),
        weak.vote(stops < 60, (stops >= 120) & (w > 40)),
        weak.vote(share("n_shouts", w) < 0.05, share("n_shouts", w) > 0.3),
        weak.vote(share("n_letters", chars) > 0.85, share("n_letters", chars) < 0.7),
        weak.vote(share("n_bare", w) < 0.1, share("n_bare", w) > 0.2),
        weak.vote(F.col("has_function_word"), ~F.col("has_function_word") & (w > 50)),
    ]


def judge(docs: DataFrame, text: str = "text", least: float = 0.5, keep_text: bool = False) -> DataFrame:
    """The documents' columns and the measures, base_failed, quality (posterior) and kept.

    A null, empty or blank text has no word and fails. Repeated rows are judged each (and count
    each in the estimation). A result replaces an input column of its name. The reliabilities are
    estimated from all documents given; of an empty table nothing is estimated.

    Without the text the measures are written once and read for estimation and judgement; with it
    they are computed twice, so that texts are not written.
    """
    rules = votes()
    if keep_text:
        measured, seen = measures(docs, text), measures(docs.select(text), text)
    else:
        measured = seen = settle(measures(docs, text).drop(text), "quality")
    patterns = weak.counted(seen, rules)
    total = sum(n for _, n in patterns)
    r = weak.estimate(patterns, len(rules), prior=0.8, on_positive=0.98, on_negative=0.8, smoothing=TRUST * total)
    w = F.col("n_words")
    return (measured.withColumn("base_failed", (w < 10) | (100 * F.col("n_repeat_words") > 20 * w))
            .withColumn("quality", weak.posterior(rules, r))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)))
