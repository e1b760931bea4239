"""Scores of translations and of spoken lines, and their group summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.python_text import normalize_speech, speech_pair
from ..session import settle

ACCURACY = 10000
GRAM_CHUNK = 50_000             # characters whose grams are sorted together
MARGINS = [2.0 ** -k for k in range(12, 1, -1)] + [1.0]


# --- per row -------------------------------------------------------------------------------------

def spoken_key(text, language) -> Column:
    """Normalized text without spaces, the unit of all speech comparisons."""
    return F.replace(normalize_speech(text, language), F.lit(" "), F.lit(""))


def cer_of(pair: Column) -> Column:
    """Edit distance over the reference length, of a `speech_pair`; an empty reference scores 0 or 1."""
    return F.when(pair["r"] == 0, F.when(pair["h"] == 0, 0.0).otherwise(1.0)).otherwise(pair["distance"] / pair["r"])


def run_on_of(pair: Column) -> Column:
    """How much longer the transcript is, as a share of the text."""
    return F.greatest(pair["h"] - pair["r"], F.lit(0)) / F.greatest(pair["r"], F.lit(1))


def speech_errors(clips: DataFrame, hyp: str = "hyp", ref: str = "ref", language: str = "language") -> DataFrame:
    """Add `cer` and `extra` (run-on share) of every clip."""
    c = clips.withColumn("_p", speech_pair(F.col(hyp), F.col(ref), F.col(language), F.lit(False)))
    return c.withColumns({"cer": cer_of(F.col("_p")), "extra": run_on_of(F.col("_p"))}).drop("_p")


def line_errors(lines: DataFrame, heard: str = "hyp", text: str = "ref", language: str = "language") -> DataFrame:
    """Add `line_error`: how badly a transcript misses its line, 0.5 or more when it fails.

    In languages not written in Latin letters, names kept in Latin letters are left out of the
    comparison on both sides, and the speech may be longer by about their length.
    """
    names = F.when(F.col(language).isin(K.LATIN_TARGETS), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(text, F.lit(K.LATIN_WORD_PATTERN), 0))
    c = lines.withColumn("_names", names)
    some = F.size("_names") > 0

    def side(col):
        return F.when(some, F.regexp_replace(col, K.LATIN_WORD_PATTERN, " ")).otherwise(F.col(col))

    c = c.withColumn("_p", speech_pair(side(heard), side(text), F.col(language), F.coalesce(some, F.lit(False))))
    p = F.col("_p")
    plain = cer_of(p)
    plain = F.when(run_on_of(p) > K.RUN_ON, F.greatest(plain, F.lit(K.FAILED_CER))).otherwise(plain)
    room = F.aggregate("_names", F.lit(0), lambda a, n: a + F.length(n)) * 1.5
    rest = 1.0 - p["common"] / p["r"]
    rest = F.when((p["h"] - p["r"] - room) / p["r"] > K.RUN_ON,
                  F.greatest(rest, F.lit(K.FAILED_CER))).otherwise(rest)
    error = F.when(~some, plain).when(p["r"] == 0, 0.0).otherwise(rest)
    return c.withColumn("line_error", error).drop("_names", "_p")


def gram_totals(hyp: str, ref: str, order: int) -> list[int]:
    """For n = 1..order in turn: character n-grams of the first text, of the second, and matched ones."""
    out = []
    for n in range(1, order + 1):
        h, r = (Counter(t[i:i + n] for i in range(len(t) - n + 1)) for t in (hyp, ref))
        out += [h.total(), r.total(), (h & r).total()]
    return out


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about GRAM_CHUNK characters."""
    a = size = 0
    for b, n in enumerate(sizes, 1):
        size += n
        if size >= GRAM_CHUNK or b == len(sizes):
            yield a, b
            a, size = b, 0


def all_gram_totals(hyp: Sequence[str], ref: Sequence[str], order: int) -> list[list[int]]:
    """gram_totals of every pair. Where row, side and gram fit 63 bits, a chunk's grams are sorted as numbers, an order at a time."""
    out: list[list[int]] = []
    for a, b in _chunks([len(h) + len(r) for h, r in zip(hyp, ref)]):
        texts = [*hyp[a:b], *ref[a:b]]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.unique(codes)
        bits, rows = max(1, len(letters) - 1).bit_length(), b - a
        if order * bits + rows.bit_length() + 1 > 63:
            out += [gram_totals(h, r, order) for h, r in zip(hyp[a:b], ref[a:b])]
            continue
        sizes = np.array([len(t) for t in texts])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))          # characters from each one to its text's end
        of = np.repeat(np.arange(2 * rows), sizes)
        row, side = of % rows, of // rows
        code = np.searchsorted(letters, codes).astype(np.int64)
        totals, gram = np.zeros((rows, 3 * order), np.int64), np.zeros(len(codes), np.int64)
        for n in range(1, order + 1):
            gram = gram[:len(code) - n + 1] << bits | code[n - 1:]
            whole = np.flatnonzero(left[:len(gram)] >= n)
            key = np.sort(row[whole] << (n * bits + 1) | gram[whole] << 1 | side[whole])
            pair = key >> 1
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(key) else np.zeros(0, np.int64)
            theirs = np.add.reduceat(key & 1, first) if len(first) else first
            ours = np.diff(np.append(first, len(key))) - theirs
            matched = np.bincount(pair[first] >> (n * bits), np.minimum(ours, theirs), rows)
            totals[:, 3 * n - 3] = np.maximum(sizes[:rows] - n + 1, 0)
            totals[:, 3 * n - 2] = np.maximum(sizes[rows:] - n + 1, 0)
            totals[:, 3 * n - 1] = matched.astype(np.int64)
        out += totals.tolist()
    return out


def chrf(rows: DataFrame, keys: Sequence[str], row_key: str = "clip_id", hyp: str = "hyp", ref: str = "ref",
         order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF per group: character n-gram F-score, precision and recall averaged over orders.

    Grams, white space ignored, are matched inside a sentence pair only: a pair is one row, and its
    three totals for each order are all that goes on to the sums. Null texts have no grams.
    """
    keys = list(keys)

    def bare(text):
        return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit(""))

    @F.pandas_udf("array<bigint>")
    def totals(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(all_gram_totals(h.tolist(), r.tolist(), order))

    t = rows.select(*keys, totals(bare(hyp), bare(ref)).alias("_t"))
    sums = t.groupBy(*keys).agg(*[F.sum(F.get("_t", F.lit(i))).alias(f"_{i}") for i in range(3 * order)])

    def mean(of: int) -> Column:
        """Average over the orders that both sides have of matched grams over those of one side."""
        parts = F.array(*[F.when((F.col(f"_{i}") > 0) & (F.col(f"_{i + 1}") > 0), F.col(f"_{i + 2}") / F.col(f"_{i + of}"))
                          for i in range(0, 3 * order, 3)])
        known = F.filter(parts, lambda x: x.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))

    s = sums.select(*keys, mean(0).alias("p"), mean(1).alias("rc"))
    f2 = beta ** 2
    score = F.when(F.col("p") + F.col("rc") > 0, 100 * (1 + f2) * F.col("p") * F.col("rc") / (f2 * F.col("p") + F.col("rc")))
    return s.select(*keys, F.coalesce(score, F.lit(0.0)).alias("chrf"))


# --- group summaries ---------------------------------------------------------------------------------

def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float],
                    aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours) of groups of any size.

    A bounded sketch brackets every quantile; only the thin slice of rows inside a bracket is
    pre-aggregated by value and ranked, and rows below a bracket are merely counted. So no group
    is gathered in one task, and the answer is still exact. The rows are read twice, so pass a
    stored table. `aggs` are further aggregates, computed along with the sketch.
    """
    keys = list(keys)
    names = list(qs)
    rows = rows.where(F.col(value).isNotNull()).select("*", F.col(value).cast("double").alias("_v"))
    probes = [p for q in qs.values() for m in MARGINS for p in (max(q - m, 0.0), min(q + m, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", probes, ACCURACY).alias("_a"),
        *[c.alias(n) for n, c in (aggs or {}).items()])
    basics = sketch.select(*keys, *(aggs or {}))
    need = F.lit(2.0) / F.col("_n") + F.lit(2.0 / ACCURACY)

    def bound(qi, side):
        at = qi * 2 * len(MARGINS)
        return F.coalesce(*[F.when(F.lit(m) >= need, F.col("_a")[at + 2 * i + side]) for i, m in enumerate(MARGINS)],
                          F.col("_a")[at + 2 * (len(MARGINS) - 1) + side])

    sketch = sketch.select(*keys, "_n", F.array(*[
        F.struct(F.lit(n).alias("q"), F.lit(float(q)).alias("at"), bound(i, 0).alias("lo"), bound(i, 1).alias("hi"))
        for i, (n, q) in enumerate(qs.items())]).alias("_b"))
    near = rows.select(*keys, "_v").join(sketch, keys).select(*keys, "_n", "_v", F.explode("_b").alias("b")).where("_v <= b.hi")
    inside = F.col("_v") >= F.col("b.lo")
    counted = near.groupBy(*keys, F.col("b.q").alias("q"), F.col("b.at").alias("at"),
                           F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("c"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys, "q").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    pos = (F.col("_n") - 1) * F.col("at")

    def pick(rank):
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("_v")))

    out = ranked.groupBy(*keys, "q").agg(
        pick(F.floor(pos)).alias("a"), pick(F.ceil(pos)).alias("b"), F.max(pos - F.floor(pos)).alias("f"))
    one = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    out = out.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == n, one)).alias(n) for n in names])
    return out.join(basics, keys) if aggs else out


def summarize(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """mean, median, p90, min, max and n of every value column per group (nulls skipped)."""
    keys = list(keys)
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m"))
    long = settle(long.select(*keys, "m.metric", "m.value").where("value is not null"), "values")
    out = exact_quantiles(long, [*keys, "metric"], "value", {"median": 0.5, "p90": 0.9}, {
        "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "n": F.count(F.lit(1))})
    return out.select(*keys, "metric", "mean", "median", "p90", "min", "max", "n")


def score_summary(scores: DataFrame, keys: Sequence[str] = ("engine", "language"),
                  metrics: Sequence[str] = ("cer", "similarity", "seconds_per_char", "synthesis_seconds")) -> DataFrame:
    """One row per group: every metric's mean and median, failed and babble shares, clip count."""
    keys = list(keys)
    scores = settle(scores.select(*dict.fromkeys([*keys, "cer", "extra", *metrics])), "scores")
    stats = summarize(scores, keys, metrics)
    wide = stats.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in ("mean", "median", "p90")])
    rates = scores.groupBy(*keys).agg(
        F.avg((F.col("cer") > K.FAILED_CER).cast("double")).alias("failed_rate"),
        F.avg((F.col("extra") > K.RUN_ON).cast("double")).alias("babble_rate"),
        F.count(F.lit(1)).alias("clips"))
    return rates.join(wide, keys, "left")


def rate_vs_native(summary: DataFrame, native: str = "native") -> DataFrame:
    """Add `rate_vs_native`: native seconds per character over the engine's, per language."""
    base = summary.where(F.col("engine") == native).select("language", F.col("seconds_per_char_median").alias("_nat"))
    return summary.join(base, "language", "left").withColumn(
        "rate_vs_native", F.col("_nat") / F.col("seconds_per_char_median")).drop("_nat")


def real_time_factor(clips: DataFrame, keys: Sequence[str], work: str = "work_ms", audio: str = "audio_ms") -> DataFrame:
    """Work time over audio time, of the sums; with the mean error and the failed share."""
    return clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("cer").alias("mean_cer"),
        F.avg((F.col("cer") > K.FAILED_CER).cast("double")).alias("failed_rate"),
        (F.sum(work) / F.sum(audio)).alias("real_time_factor"))


def length_ratio(rows: DataFrame, keys: Sequence[str], out: str = "hyp", ref: str = "ref") -> DataFrame:
    """Summary of output length over reference length."""
    ratio = F.length(out) / F.greatest(F.length(ref), F.lit(1))
    return summarize(rows.select(*keys, ratio.alias("length_ratio")), keys, ["length_ratio"])


def align_parallel(sources: DataFrame, references: DataFrame, on: Sequence[str] = ("line_no",)) -> DataFrame:
    """Sentence i of one language with sentence i of another."""
    return sources.select(*on, F.col("text").alias("source")).join(
        references.select(*on, F.col("text").alias("reference")), list(on))


def best_engine_cells(results: DataFrame, direction: Sequence[str] = ("source", "target"), score: str = "chrf") -> DataFrame:
    """Add `best`: the score equals the best of its direction. One row per engine and direction."""
    top = results.groupBy(*direction).agg(F.max(score).alias("_top"))
    return results.join(top, list(direction), "left").withColumn(
        "best", F.coalesce(F.col(score) == F.col("_top"), F.lit(False))).drop("_top")


def verdicts(groups: DataFrame, bad: Column) -> DataFrame:
    """For each measure: the bad group's value, the worst good group's, and whether they separate."""
    good = groups.where(~bad).agg(
        F.max("cer_mean").alias("cer"), F.max("failed_rate").alias("failed"), F.max("babble_rate").alias("babble"))
    one = groups.where(bad).select(
        F.col("cer_mean").alias("b_cer"), F.col("failed_rate").alias("b_failed"), F.col("babble_rate").alias("b_babble"),
        F.coalesce("rate_vs_native", F.lit(1.0)).alias("b_rate"), *[c for c in groups.columns if c in ("engine", "language")])
    both = one.crossJoin(F.broadcast(good))          # `good` is one row
    keys = [c for c in groups.columns if c in ("engine", "language")]
    m = F.array(
        F.struct(F.lit("mean_cer").alias("measure"), F.col("b_cer").alias("bad"), F.col("cer").alias("worst_native"),
                 (F.col("b_cer") >= K.CER_FACTOR * F.col("cer")).alias("separates")),
        F.struct(F.lit("failed_rate").alias("measure"), F.col("b_failed").alias("bad"),
                 F.col("failed").alias("worst_native"), (F.col("b_failed") > F.col("failed")).alias("separates")),
        F.struct(F.lit("babble_rate").alias("measure"), F.col("b_babble").alias("bad"),
                 F.col("babble").alias("worst_native"), (F.col("b_babble") > F.col("babble")).alias("separates")),
        F.struct(F.lit("rate_vs_native").alias("measure"), F.col("b_rate").alias("bad"), F.lit(1.0).alias("worst_native"),
                 (~F.col("b_rate").between(*K.NATURAL_RATE)).alias("separates")))
    return both.select(*keys, F.explode(m).alias("v")).select(*keys, "v.*")


# --- reports ------------------------------------------------------------------------------------------

def pivot_report(results: DataFrame, engines: Sequence[str], score: str = "chrf") -> DataFrame:
    """Directions down, engines across; best cell bold, "n/a" if unsupported, empty if missing."""
    r = best_engine_cells(results, score=score)
    text = F.format_string("%.1f (%.2f, %.1fs)", F.col(score), F.col("meaning"), F.col("seconds_per_sentence"))
    cell = F.when(F.col(score).isNull(), "n/a").when(F.col("best"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
    wide = r.withColumn("_cell", cell).groupBy("source", "target").pivot("engine", list(engines)).agg(F.first("_cell"))
    return wide.select(F.concat("source", F.lit("→"), "target").alias("direction"),
                       *[F.coalesce(e, F.lit("")).alias(e) for e in engines])


def asr_report(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Languages down, models across: mean error and real-time factor."""
    cell = F.format_string("%.3f (%.2fx)", F.col("mean_cer"), F.col("real_time_factor"))
    wide = results.withColumn("_cell", cell).groupBy("language").pivot("model", list(models)).agg(F.first("_cell"))
    return wide.select("language", *[F.coalesce(m, F.lit("")).alias(m) for m in models])


def speech_report(summary: DataFrame, unsupported: str | None = None) -> DataFrame:
    """Rows by language, the native group first, then engines by name; unsupported rows dropped."""
    s = summary.where(F.col(unsupported).isNull()) if unsupported else summary
    pct = lambda c: F.format_string("%.0f%%", F.bround(F.col(c) * 100, 0))
    rank = F.when(F.col("engine") == "native", 0).otherwise(1)

    def shown(c: str, form: str) -> Column:
        return F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, c)), F.lit("-")) if c in s.columns else F.lit("-")

    s = s.select(
        "language", "engine", F.format_string("%.3f", "cer_mean").alias("mean_cer"),
        pct("failed_rate").alias("failed_lines"), pct("babble_rate").alias("babble"),
        F.format_string("%.2fx", "rate_vs_native").alias("rate"),
        shown("similarity_median", "%.3f").alias("speaker_sim"), shown("real_time_factor", "%.2f").alias("rtf"))
    return s.orderBy("language", rank, "engine")


# --- benchmark sampling ----------------------------------------------------------------------------------

def voice_line_jobs(recordings: DataFrame, keys: Sequence[str] = ("language",), order: str = "clip_id") -> DataFrame:
    """Voice i reads the text of recording i + 1; the last one reads the first text."""
    from .ordered import ordered
    out = ordered(recordings, lead={"_t": F.col("ref")}, keys=keys, order=order)
    first = recordings.groupBy(*keys).agg(F.min_by("ref", order).alias("_f"))
    ends = out.where("_t is null").join(first, list(keys)).withColumn("_t", F.col("_f")).drop("_f")
    return out.where("_t is not null").unionByName(ends).withColumnRenamed("_t", "line_text")


def interleave_groups(rows: DataFrame, group: str, order: str, count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Take rows from the groups in turn, groups in order of first appearance, until `count` rows.

    A group gives at most `count` rows, so the ranking is limited before anything is shuffled.
    """
    keys = list(keys)
    first = rows.groupBy(*keys, group).agg(F.min(order).alias("_seen"))
    w = Window.partitionBy(*keys, group).orderBy(order)
    r = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count)
    r = r.join(first, [*keys, group])
    w2 = Window.partitionBy(*keys).orderBy("_rn", "_seen")
    return r.withColumn("pick", F.row_number().over(w2)).where(F.col("pick") <= count).drop("_rn", "_seen")


def samples(rows: DataFrame, keys: Sequence[str], order: str, count: int = 5) -> DataFrame:
    """The first rows of every group (limited per task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= count)


def skip_done(jobs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a stored result. An unsupported pair counts as stored, a failure does not."""
    stored = results.where("failure is null") if "failure" in results.columns else results
    return jobs.join(stored.select(*keys).distinct(), list(keys), "left_anti")
