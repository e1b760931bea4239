"""Voice prompts: the whole words of a speaker's clips, up to the length that clones best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def whole_words(words: DataFrame) -> DataFrame:
    """Words heard whole inside their clip: (keys, clip_no, clip_seconds, words array).

    A clip's words are bounded by its length, and clips by the reference length.
    """
    inside = (F.col("start") > K.PROMPT_EDGE) & (F.col("end") < F.col("clip_seconds") - K.PROMPT_EDGE)
    # dealt by speaker, not by clip: voice_prompt then puts a speaker's clips together without moving them again
    w = words.where(inside).repartition("track_id", "speaker")
    return w.groupBy("track_id", "speaker", "clip_no", "clip_seconds").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("words"))


def voice_prompt(words: DataFrame) -> DataFrame:
    """Per speaker the clips used, in order, each with its cut and text.

    Carries the room left from clip to clip: a clip gives its whole words that still fit; one
    with under a second left to add is skipped.
    """
    clips = whole_words(words).groupBy("track_id", "speaker").agg(
        F.array_sort(F.collect_list(F.struct("clip_no", "clip_seconds", "words"))).alias("clips"))
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n"), F.array().cast(
        "array<struct<clip_no:bigint,cut_start:double,cut_end:double,text:string>>").alias("out"))

    def step(s, c):
        limit = K.PROMPT_SECONDS - s["used"] - F.when(s["n"] > 0, K.PROMPT_GAP).otherwise(0.0)
        begin = F.greatest(F.lit(0.0), c["words"][0]["start"] - K.PROMPT_ROOM[0])
        fits = F.filter(c["words"], lambda w: (w["end"] + K.PROMPT_ROOM[1] - begin) <= limit)
        end = F.least(c["clip_seconds"], F.element_at(fits, -1)["end"] + K.PROMPT_ROOM[1])
        text = F.trim(F.array_join(F.transform(fits, lambda w: w["word"]), ""))
        take = (limit > 0) & (F.size(fits) > 0) & (text != "") & ((s["n"] == 0) | (end - begin >= K.PROMPT_MIN_PIECE))
        piece = F.struct(c["clip_no"].cast("bigint").alias("clip_no"), begin.alias("cut_start"), end.alias("cut_end"), text.alias("text"))
        used = s["used"] + F.when(s["n"] > 0, K.PROMPT_GAP).otherwise(0.0) + (end - begin)
        return F.struct(
            F.when(take, used).otherwise(s["used"]).alias("used"),
            F.when(take, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(take, F.array_append(s["out"], piece)).otherwise(s["out"]).alias("out"))

    return clips.select("track_id", "speaker", F.explode(F.aggregate("clips", start, step, lambda s: s["out"])).alias("p")).select(
        "track_id", "speaker", "p.*")
