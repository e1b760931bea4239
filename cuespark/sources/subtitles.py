"""Subtitle readers: documents (path, value) to cue rows.

Readers take a table of whole files, from `read_documents` or any other table with the columns
path and value. Parsing stays in the JVM but for HTML entities, which need Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.python_text import html_unescape
from ..functions.text import MARKUP, collapse, let, strip_ass, to_seconds, trim_ws

ARROW = r"-->"
SBV_LINE = r"^\d+:\d{2}:\d{2}\.\d{3}\s*,\s*\d+:\d{2}:\d{2}\.\d{3}$"
LRC_LINE = r"^\[(\d+):(\d+(?:\.\d+)?)\](.*)$"


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """Whole subtitle files as (path, value)."""
    return (spark.read.text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), "value"))


def _plain(value) -> Column:
    """Without a byte-order mark, and with \\n as the only line end."""
    v = F.regexp_replace(F.col(value) if isinstance(value, str) else value, "^﻿", "")
    return F.regexp_replace(v, "\r\n?", "\n")


def _blocks(text: Column) -> Column:
    """Non-empty lines of every blank-line separated block: array<array<string>>."""
    def lines(b):
        return F.filter(F.transform(F.split(b, "\n"), trim_ws), lambda x: x != "")
    return F.filter(F.transform(F.split(trim_ws(text), "\n{2,}"), lines), lambda b: F.size(b) > 0)


def _timed(docs: DataFrame, text: Column, find: str, cut: str) -> DataFrame:
    """Cues of formats that put a time line above the text; ids are block numbers."""
    b = docs.select("path", F.posexplode(_blocks(text)).alias("id", "_b"))
    at = F.array_position(F.transform("_b", lambda x: x.rlike(find)), True)
    b = b.withColumn("_at", at.cast("int")).where("_at > 0")
    b = b.withColumn("_t", F.split(F.element_at("_b", F.col("_at")), cut, 2)).where("size(_t) = 2")
    b = b.select(
        "path", F.col("id").cast("bigint").alias("id"), F.element_at("_t", 1).alias("_from"),
        F.element_at(F.split(trim_ws(F.element_at("_t", 2)), r"(?U)\s+"), 1).alias("_to"),
        F.array_join(F.slice("_b", F.col("_at") + 1, F.size("_b")), " ").alias("_raw"))
    b = b.withColumn("_raw", F.regexp_replace("_raw", MARKUP, ""))
    return b.select(
        "path", "id", to_seconds("_from").alias("start"), to_seconds("_to").alias("end"),
        collapse(html_unescape("_raw")).alias("text"),
        F.when(F.col("_to") == "", "time line without an end").alias("error"))


def _srt(docs):
    return _timed(docs, _plain("value"), ARROW, r"\s*-->\s*")


def _vtt(docs):
    lines = F.split(_plain("value"), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(ARROW) | trim_ws(x).rlike(r"^\d")), True).cast("int")
    body = F.array_join(F.slice(lines, F.when(at == 0, 2).otherwise(at), F.size(lines)), "\n")
    return _timed(docs, body, ARROW, r"\s*-->\s*")


def _sbv(docs):
    return _timed(docs, _plain("value"), SBV_LINE, r"\s*,\s*")


def _lrc(docs):
    lines = F.transform(F.split(_plain("value"), "\n"), trim_ws)

    def entry(x):
        return F.struct(
            (F.regexp_extract(x, LRC_LINE, 1).try_cast("bigint") * 60
             + F.regexp_extract(x, LRC_LINE, 2).try_cast("double")).alias("start"),
            trim_ws(F.regexp_extract(x, LRC_LINE, 3)).alias("text"))

    kept = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(LRC_LINE)), entry), lambda e: e["text"] != "")
    # a line ends where the next begins: told before the lines become rows, so that no row carries the others
    timed = let(kept, lambda es: F.transform(es, lambda e, i: F.struct(
        e["start"].alias("start"), F.coalesce(F.get(es, i + 1)["start"], e["start"] + K.LRC_LAST_LINE_SECONDS).alias("end"),
        e["text"].alias("text"))))
    d = docs.select("path", F.posexplode(timed).alias("id", "e"))
    return d.select(
        "path", F.col("id").cast("bigint").alias("id"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.text").alias("text"),
        F.lit(None).cast("string").alias("error"))


def _ass(docs):
    lines = F.transform(F.split(_plain("value"), "\n"), trim_ws)
    spoken = F.filter(lines, lambda x: F.lower(F.substring(x, 1, 9)) == "dialogue:")
    fields = F.filter(F.transform(spoken, lambda x: F.split(F.substr(x, F.lit(10)), ",", 10)), lambda f: F.size(f) == 10)
    cues = F.filter(F.transform(fields, lambda f: F.struct(
        to_seconds(F.element_at(f, 2)).alias("start"), to_seconds(F.element_at(f, 3)).alias("end"),
        strip_ass(F.element_at(f, 10)).alias("text"))), lambda c: c["text"] != "")
    d = docs.select("path", F.posexplode(cues).alias("id", "c"))
    return d.select("path", F.col("id").cast("bigint").alias("id"), "c.start", "c.end", "c.text",
                    F.lit(None).cast("string").alias("error"))


PARSERS = {"srt": _srt, "vtt": _vtt, "sbv": _sbv, "lrc": _lrc, "ass": _ass, "ssa": _ass}


def parse(docs: DataFrame, fmt: str) -> DataFrame:
    """Cues (path, id, start, end, text, error) of documents in one format.

    Cues without text are dropped. `error` is set on a block that makes its file unreadable.
    """
    out = PARSERS[fmt](docs)
    return out.where("text <> '' or error is not null")


def extension(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"[^/.][^/]*\.([^./]*)$", 1))


def read_subtitles(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues of all readable files, errors per file): a bad file fails alone.

    Files are told apart by their extension; an unknown extension is an error.
    """
    d = docs.withColumn("_ext", extension("path"))
    known = {"srt": ["srt"], "vtt": ["vtt"], "sbv": ["sbv"], "lrc": ["lrc"], "ass": ["ass", "ssa"]}
    rows = None
    for fmt, exts in known.items():
        part = parse(d.where(F.col("_ext").isin(exts)).select("path", "value"), fmt)
        rows = part if rows is None else rows.unionByName(part)
    bad = rows.where(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("message"))
    unknown = d.where(~F.col("_ext").isin(K.SUBTITLE_EXTENSIONS)).select(
        "path", F.concat(F.lit("Unsupported subtitle extension: '"), F.when(F.col("_ext") != "", F.concat(F.lit("."), F.col("_ext"))).otherwise(""), F.lit("'")).alias("message"))
    errors = bad.unionByName(unknown)
    cues = rows.join(bad.select("path"), "path", "left_anti").drop("error")
    return cues, errors


def read_srt(docs):
    return parse(docs, "srt")


def read_vtt(docs):
    return parse(docs, "vtt")


def read_sbv(docs):
    return parse(docs, "sbv")


def read_lrc(docs):
    return parse(docs, "lrc")


def read_ass(docs):
    return parse(docs, "ass")
