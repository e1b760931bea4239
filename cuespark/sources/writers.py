"""Subtitle documents from cue tables: SRT, VTT, LRC, ASS, SBV.

A track is one document, whatever its ids: a reader takes it back as one file. It is one row and
so must stay below 2 GB; a larger one fails openly when its string is built.

A word longer than a line is cut for display, and a reader cannot tell such a cut from a space between two words. Documents that
are to be read back are written with `whole_words`, which never cuts one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import (
    ass_time, cue_text, line_limit, lrc_time, sbv_time, srt_time, vtt_escape, vtt_time)
from ..functions.wrap import wrap_text
from ..operators.ordered import ordered

# Fixed header lines of an ASS document (format and style lines are part of the format).
ASS_HEADER = [
    "[Script Info]",
    "Title: Subtitle export",
    "ScriptType: v4.00+",
    "WrapStyle: 0",
    "ScaledBorderAndShadow: yes",
    "YCbCr Matrix: None",
    "",
    "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, "
    "BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
    "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1",
    "",
    "[Events]",
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
]


def _documents(rows: DataFrame, entry: Column, header: str = "") -> DataFrame:
    """The entries of every track in id order, behind the header."""
    d = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("_e"))
    body = F.array_join(F.transform("_e", lambda s: s["e"]), "\n")
    return d.select("track_id", F.size("_e").cast("bigint").alias("n_cues"), F.concat(F.lit(header), body).alias("document"))


def _shown(cues: DataFrame, translated: bool) -> DataFrame:
    return cues.withColumn("_text", cue_text(cues.columns, translated)).where("_text <> ''")


def _lines(cues: DataFrame, max_len: int, max_lines: int, whole_words: bool) -> Column:
    """Lines of `max_len`, or shorter ones where the track's script, else its language, is written without spaces."""
    told = [F.when(F.col(c) != "", F.col(c)) for c in ("script", "language") if c in cues.columns]
    return wrap_text("_text", line_limit(F.coalesce(*told), max_len) if told else max_len, max_lines, whole_words)


def write_srt(cues: DataFrame, *, translated=False, max_len=K.MAX_LINE_LENGTH, max_lines=K.MAX_LINES, whole_words=False) -> DataFrame:
    rows = ordered(_shown(cues, translated), sums={"_n": F.lit(1).cast("bigint")})
    entry = F.concat_ws("\n", (F.col("_n") + 1).cast("string"),
                        F.concat(srt_time("start"), F.lit(" --> "), srt_time("end")),
                        F.array_join(_lines(cues, max_len, max_lines, whole_words), "\n"), F.lit(""))
    return _documents(rows, entry)


def write_vtt(cues: DataFrame, *, translated=False, max_len=K.MAX_LINE_LENGTH, max_lines=K.MAX_LINES, whole_words=False) -> DataFrame:
    entry = F.concat_ws("\n", F.concat(vtt_time("start"), F.lit(" --> "), vtt_time("end")),
                        F.array_join(F.transform(_lines(cues, max_len, max_lines, whole_words), vtt_escape), "\n"), F.lit(""))
    return _documents(_shown(cues, translated), entry, header="WEBVTT\n\n")


def write_lrc(cues: DataFrame, *, translated=False) -> DataFrame:
    entry = F.concat(F.lit("["), lrc_time("start"), F.lit("]"), F.col("_text"))
    return _documents(_shown(cues, translated), entry)


def write_sbv(cues: DataFrame, *, translated=False, max_len=K.MAX_LINE_LENGTH, max_lines=K.MAX_LINES, whole_words=False) -> DataFrame:
    entry = F.concat_ws("\n", F.concat(sbv_time("start"), F.lit(","), sbv_time("end")),
                        F.array_join(_lines(cues, max_len, max_lines, whole_words), "\n"), F.lit(""))
    return _documents(_shown(cues, translated), entry)


def write_ass(cues: DataFrame, *, translated=False, max_len=K.MAX_LINE_LENGTH, max_lines=K.MAX_LINES, whole_words=False) -> DataFrame:
    entry = F.concat(F.lit("Dialogue: 0,"), ass_time("start"), F.lit(","), ass_time("end"),
                     F.lit(",Default,,0,0,0,,"), F.array_join(_lines(cues, max_len, max_lines, whole_words), "\\N"))
    return _documents(_shown(cues, translated), entry, header="\n".join(ASS_HEADER) + "\n")


WRITERS = {"srt": write_srt, "vtt": write_vtt, "lrc": write_lrc, "ass": write_ass, "sbv": write_sbv}


def save_documents(documents: DataFrame, path: str) -> None:
    """Write each document as text under path/track_id=.../."""
    (documents.select("track_id", F.col("document").alias("value"))
     .write.partitionBy("track_id").mode("errorifexists").text(path))
