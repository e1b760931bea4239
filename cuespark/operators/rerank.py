"""Choosing among candidate translations and takes by meaning, length and error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordered import ordered


def terms(text, ascii_words: bool = False) -> Column:
    """Distinct terms a translation keeps as written: names in capitals or CamelCase, URLs, addresses.

    With `ascii_words` a term may touch letters outside ASCII (SS in SSö), which else belong to its word.
    """
    pattern = K.ASCII_TERM_PATTERN if ascii_words else "(?U)" + K.TERM_PATTERN
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def lost_terms(source, translation, ascii_words: bool = False) -> Column:
    t = F.col(translation) if isinstance(translation, str) else translation
    return F.size(F.filter(terms(source, ascii_words), lambda x: ~F.contains(t, x)))


def penalty(source: str, translation: str, target: str, ascii_words: bool = False) -> Column:
    """What to subtract from a similarity: wrong script, odd length, lost terms (see `terms`)."""
    letters = F.length(F.regexp_replace(translation, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(translation, "[^A-Za-z]", ""))
    wrong = ~F.col(target).isin(K.LATIN_TARGETS) & (letters > 0) & (latin / F.greatest(letters, F.lit(1)) > 0.5)
    ratio = F.length(translation) / F.greatest(F.length(source), F.lit(1))
    odd = (ratio < K.LENGTH_RATIO[0]) | (ratio > K.LENGTH_RATIO[1])
    return (F.when(wrong, K.WRONG_SCRIPT_PENALTY).otherwise(0.0)
            + F.when(odd, K.LENGTH_PENALTY).otherwise(0.0)
            + lost_terms(source, translation, ascii_words) * F.lit(K.LOST_TERM_PENALTY))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(vector) -> Column:
    """Scaled to length 1; the zero vector stays zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scale = F.when(norm > 0, norm).otherwise(1.0)
    from ..functions.text import let
    return let(F.struct(v.alias("v"), scale.alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def adjusted_similarity(rows: DataFrame, source_vec: str = "source_vec", out_vec: str = "out_vec",
                        source: str = "source_text", out: str = "text", target: str = "target", ascii_words: bool = False) -> DataFrame:
    """Add `score`: cosine of two unit vectors less the penalty."""
    return rows.withColumn("score", dot(F.col(source_vec), F.col(out_vec)) - penalty(source, out, target, ascii_words))


def choose_candidate(candidates: DataFrame, keys: Sequence[str] = ("sentence_id", "target"),
                     spoken_from: str | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """The best candidate per sentence, the first on ties.

    With `spoken_from`, the language of the original of a translation that will be spoken: among
    the candidates nearly as good as the best, the one that takes about as long to say wins.
    Sentences without any candidate get an empty text and score 0 when `sentences` is given.
    """
    keys = list(keys)
    rate = F.lit(None).cast("double")
    for lang, seconds in K.SECONDS_PER_CHAR.items():
        rate = F.when(F.col("target") == lang, seconds).otherwise(rate)
    by_length = rate.isNotNull() if spoken_from in K.SECONDS_PER_CHAR else F.lit(False)
    said = F.length("source_text") * K.SECONDS_PER_CHAR.get(spoken_from or "", 0.0)
    c = candidates.withColumn("_top", F.max("score").over(Window.partitionBy(*keys)))
    close = by_length & (F.col("score") >= F.col("_top") - K.LENGTH_TOLERANCE)
    c = c.where(close | (~by_length & (F.col("score") == F.col("_top"))))
    diff = F.when(by_length, F.abs(F.length("text") * rate - said)).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy(diff, "cand_ix")
    best = c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, "cand_ix", "text", "score")
    if sentences is None:
        return best
    return sentences.select(*keys).join(best, keys, "left").select(
        *keys, "cand_ix", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def doubtful(rows: DataFrame, score: str = "score", original: str = "source_text", translated: str = "text") -> DataFrame:
    """Lines whose translation may not say the same; only where both texts are there."""
    both = (F.coalesce(original, F.lit("")) != "") & (F.coalesce(translated, F.lit("")) != "")
    return rows.where(both & (F.col(score) < K.DOUBT_THRESHOLD))


def first_numbers(rows: DataFrame, number: str, keys: Sequence[str] = ("track_id",), count: int = 10) -> DataFrame:
    """Per group: how many numbers there are, and the first ten of them as a list for a note.

    Only the first `count` of a group are ever brought together.
    """
    keys = list(keys)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(number)
    top = rows.select(*keys, number).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count)
    top = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(number)), ", ").alias("listed"))
    return total.join(top, keys).select(
        *keys, "n", F.concat("listed", F.when(F.col("n") > count, " ...").otherwise("")).alias("listed"))


def cue_positions(cues: DataFrame) -> DataFrame:
    """Add `number`, the position of every cue in its track, from 1."""
    return ordered(cues, sums={"_n": F.lit(1).cast("bigint")}).withColumn("number", F.col("_n") + 1).drop("_n")


def doubt_report(doubts: DataFrame, number: str = "number") -> DataFrame:
    """Per track: a note naming doubtful units by their first cue's number."""
    out = first_numbers(doubts, number)
    return out.withColumn("note", F.concat(
        F.col("n").cast("string"), F.lit(" line(s) may not say the same as the original (subtitle "), "listed",
        F.lit("). Review them, or try another translation model.")))


def translation_prompt(text: str, source: str, target: str, ascii_words: bool = False) -> Column:
    """The instruction given to a translation model, with a glossary of terms (see `terms`) to keep as written."""
    t, src, tgt = F.col(text), F.col(source), F.col(target)
    kept = F.when(tgt.isin(K.LATIN_TARGETS), F.array().cast("array<string>")).otherwise(F.array_sort(terms(t, ascii_words)))
    english, chinese = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, name in K.PROMPT_LANGUAGE_NAMES.items():
        english = F.when(tgt == code, name).otherwise(english)
        chinese = F.when(tgt == code, K.PROMPT_CHINESE_NAMES[code]).otherwise(chinese)

    def glossary(middle):
        return F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(middle), x, F.lit("\n"))), "")

    some = F.size(kept) > 0
    zh = F.concat(
        F.when(some, F.concat(F.lit("参考下面的翻译：\n"), glossary(" 翻译成 "))).otherwise(""),
        F.lit("将以下文本翻译为"), chinese, F.lit("，注意只需要输出翻译后的结果，不要额外解释：\n\n"), t)
    other = F.concat(
        F.when(some, F.concat(F.lit("Reference the following translations:\n"), glossary(" translates to "), F.lit("\n"))).otherwise(""),
        F.lit("Translate the following text into "), english,
        F.lit(". Note that you should only output the translated result without any additional explanation:\n\n"), t)
    return F.when((src == "zh") | (tgt == "zh"), zh).otherwise(other)


# --- takes ------------------------------------------------------------------------------------------------

def choose_take(takes: DataFrame, keys: Sequence[str] = ("track_id", "line_no"), retakes: int = K.RETAKES) -> DataFrame:
    """The take a line keeps: takes are tried in order until one passes; the lowest error wins."""
    keys = list(keys)
    t = takes.where(F.col("attempt") <= retakes)
    t = t.withColumn("_pass", F.min(F.when(F.col("error") < K.FAILED_CER, F.col("attempt"))).over(Window.partitionBy(*keys)))
    t = t.where(F.col("_pass").isNull() | (F.col("attempt") <= F.col("_pass")))
    rest = [c for c in takes.columns if c not in keys]
    best = t.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("error", "attempt")).alias("_b"),
        F.max(F.when(F.col("attempt") == 0, F.col("error"))).alias("_e0"))
    return best.select(*keys, "_b.*", (F.col("_e0") >= K.FAILED_CER).alias("retaken"),
                       (F.col("_b.error") >= K.FAILED_CER).alias("unclear"))


def guard_runaway(takes: DataFrame, rate: int = 24000, speed: float = 1.0,
                  keys: Sequence[str] = ("track_id", "line_no")) -> DataFrame:
    """The first take of plausible length; if all run on, the shortest, cut to a plausible length.

    `frames`, if given, is how many decoder frames a take has: it can only be cut between two of them. The result then has
    `kept_frames`, and `kept_samples` is their share of the take; else the cut is to the sample.
    """
    framed = "frames" in takes.columns
    keys = list(keys)
    expected = F.greatest(F.lit(K.RUNAWAY_MIN_EXPECTED), F.col("n_chars") * K.RUNAWAY_SECONDS_PER_CHAR) / F.lit(speed)
    longest = F.floor((expected * K.RUNAWAY_FACTOR + K.RUNAWAY_MARGIN) * rate)
    ok = F.col("n_samples") <= longest
    t = takes.withColumn("_bad", (~ok).cast("int"))
    best = t.groupBy(*keys).agg(F.min_by(
        F.struct("attempt", "n_samples", "n_chars", "_bad", *(["frames"] if framed else [])),
        F.struct("_bad", F.when(ok, F.col("attempt").cast("bigint")).otherwise(F.col("n_samples").cast("bigint")), "attempt")).alias("_b"))
    best = best.select(*keys, "_b.*")
    bad = F.col("_bad") == 1
    if framed:
        fit = F.greatest(F.lit(1), F.floor(F.col("frames") * expected * K.RUNAWAY_CAP * rate / F.col("n_samples")))
        best = best.withColumn("kept_frames", F.when(bad, F.least(fit, F.col("frames"))).otherwise(F.col("frames")).cast("bigint"))
        kept = F.floor(F.col("kept_frames") * F.col("n_samples") / F.col("frames"))
    else:
        kept = F.least(F.greatest(F.lit(1), F.floor(expected * K.RUNAWAY_CAP * rate)), F.col("n_samples"))
    return best.select(
        *keys, "attempt", "n_samples", bad.alias("ran_on"), F.when(bad, kept).otherwise(F.col("n_samples")).cast("bigint").alias("kept_samples"),
        *(["kept_frames"] if framed else []))


def track_report(lines: DataFrame, keys: Sequence[str] = ("track_id",), number: str = "line_no") -> DataFrame:
    """Per track: lines spoken and sped up, and for each kind of trouble its count and first numbers."""
    keys = list(keys)
    kinds = ["trimmed", "ran_on", "retaken", "unclear"]
    out = lines.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col("spoken"), F.lit(True)) if "spoken" in lines.columns else F.lit(True)).alias("spoken"),
        F.count_if(F.coalesce("sped_up", F.lit(False))).alias("sped_up"))
    flagged = lines.select(*keys, number, F.explode(F.filter(F.array(*[
        F.when(F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())).alias("kind"))
    listed = first_numbers(flagged, number, [*keys, "kind"])
    wide = listed.groupBy(*keys).agg(*[
        f for k in kinds for f in (
            F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"n_{k}"),
            F.max(F.when(F.col("kind") == k, F.col("listed"))).alias(k))])
    return out.join(wide, keys, "left").select(
        *keys, "spoken", "sped_up", *[c for k in kinds for c in (
            F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}"), F.coalesce(k, F.lit("")).alias(k))])
