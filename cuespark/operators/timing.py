"""Cue timing and plain cue filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import is_no_space, letters, trim_ws
from .ordered import ordered, renumber


def finalize_timing(cues: DataFrame, *, min_duration: float = K.MIN_CUE_SECONDS,
                    max_duration: float = K.MAX_CUE_SECONDS, keys=("track_id",), order: str = "id") -> DataFrame:
    """Repair inverted and overlapping cues, and extend short ones to a readable time.

    A cue is never extended past the start of the next one. Starts never move, so every end
    depends on its own row and the next start only.
    """
    columns = cues.columns
    t = ordered(cues, lead={"_nx": F.col("start")}, keys=keys, order=order)
    nx = F.coalesce("_nx", F.lit(float("inf")))
    t = t.withColumn("_e", F.greatest("end", "start"))
    t = t.withColumn("_e", F.when((F.col("_e") > nx) & (nx > F.col("start")), nx).otherwise(F.col("_e")))
    wanted = F.col("start") + F.least(
        F.greatest(F.lit(min_duration), F.length("text") / F.lit(K.READING_CPS)), F.lit(max_duration))
    end = F.when(F.col("_e") < wanted, F.greatest(F.col("_e"), F.least(wanted, nx))).otherwise(F.col("_e"))
    return t.withColumn("end", end).select(*columns)


def drop_empty_cues(cues: DataFrame) -> DataFrame:
    """Remove cues without text and number the others densely."""
    columns = cues.columns
    return renumber(cues.where(F.coalesce(F.col("text"), F.lit("")) != "")).select(*columns)


def latest_cues(events: DataFrame, keys=("track_id", "id"), seq: str = "seq") -> DataFrame:
    """The last version of every re-sent cue (map-side combined, one row per cue)."""
    value = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*value), seq).alias("_v"))
    return best.select(*keys, "_v.*")


def keep_same_language(cues: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(cues already in the target language, with a note; cues that need translating)."""
    name = K.LANGUAGE_NAMES.get(target, target)
    same = F.coalesce(F.col("language"), F.lit("")) == target
    kept = cues.where(same).withColumn(
        "note", F.lit(f"The text is already in {name}, so it was kept as it is."))
    return kept, cues.where(~same)


def unchanged_tracks(cues: DataFrame, original: str = "text", converted: str = "transliterated") -> DataFrame:
    """Tracks where some cue has letters and no cue's letters were changed by conversion."""
    before, after = letters(original), letters(converted)
    return cues.groupBy("track_id").agg(
        F.bool_or(before != "").alias("_any"), F.bool_and(before == after).alias("_same")
    ).where("_any and _same").select("track_id")


def unknown_language(tracks: DataFrame, requested: str = "source_lang", known: str = "language") -> DataFrame:
    """Add `source`, the language to translate from, and `error` where it cannot be told."""
    asked = F.coalesce(F.col(requested), F.lit("auto"))
    has = F.coalesce(F.col(known), F.lit(""))
    source = F.when(asked != "auto", asked).when(has != "", has)
    return tracks.select(
        "*", source.alias("source"),
        F.when(source.isNull(), "Can't tell which language the track is in. Choose the source language.").alias("error"))


def split_rejected(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, rejected rows): one bad row never fails the others."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def union_tracks(*tracks: DataFrame) -> DataFrame:
    """Tracks from several steps or formats as one table."""
    out = tracks[0]
    for t in tracks[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def layout_for_language(tracks: DataFrame, max_len: int = K.MAX_LINE_LENGTH, max_lines: int = K.MAX_LINES) -> DataFrame:
    """Line limits per row's language."""
    limit = F.when(is_no_space("language"), min(max_len, K.NO_SPACE_MAX_LINE_LENGTH)).otherwise(max_len)
    return tracks.select("*", limit.alias("max_line_length"), (limit * max_lines).alias("max_chars"))


def joined_text(struct_list, no_space):
    """Join ordered (id, text) structs: stripped texts, with spaces unless the script has none."""
    parts = F.transform(F.array_sort(struct_list), lambda s: trim_ws(s["text"]))
    return trim_ws(F.when(no_space, F.array_join(parts, "")).otherwise(F.array_join(parts, " ")))
