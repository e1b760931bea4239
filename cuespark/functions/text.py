"""Column functions on cue text and cue times. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


# Every character Unicode calls white space, and the ASCII separators that split text as well.
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
         + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def char_class(chars: str) -> str:
    """A regular-expression class holding exactly the given characters."""
    return "[" + re.sub(r"([\\\[\]^&~-])", r"\\\1", chars) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`; lambda bodies do not share subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text) -> Column:
    """Trim, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def trim_ws(text) -> Column:
    """Drop white space of every kind from both ends."""
    return F.btrim(_col(text), F.lit(WHITE))


def is_no_space(language) -> Column:
    return F.coalesce(_col(language), F.lit("")).isin(K.NO_SPACE_LANGUAGES)


# --- sentence ends -----------------------------------------------------------------

def closed_text(text) -> Column:
    """Text without trailing white space and closing marks."""
    return F.rtrim(F.rtrim(_col(text), F.lit(WHITE)), F.lit(K.CLOSING_MARKS))


def ends_sentence(text) -> Column:
    """True when the text ends a sentence; abbreviations and initials do not end one.

    The last character decides nearly always; the last word is only looked at behind a dot.
    """
    t = closed_text(text)
    last = F.right(t, F.lit(1))
    word = F.ltrim(F.regexp_extract(t, r"(?U)(\S+)\.\z", 1), F.lit(K.OPENING_MARKS))
    shortened = F.lower(word).isin(K.ABBREVIATIONS) | (
        word.rlike(r"^\p{Lu}$") & ~word.isin("I", "A"))
    return (F.when(~last.isin(list(K.SENTENCE_END)), False).when(last != ".", True)
            .when(F.endswith(t, F.lit("..")), True).otherwise(~shortened))


def ends_with_mark(token, marks: str = K.SENTENCE_END + K.CLAUSE_END) -> Column:
    return F.coalesce(F.right(_col(token), F.lit(1)).isin(list(marks)), F.lit(False))


# --- times ---------------------------------------------------------------------------

def to_seconds(stamp) -> Column:
    """H:M:S, M:S or S as seconds; a comma is a decimal point; anything malformed is 0."""
    parts = F.split(F.replace(F.trim(_col(stamp)), F.lit(","), F.lit(".")), ":")

    def whole(i):
        return F.trim(F.get(parts, F.lit(i))).try_cast("bigint")

    def real(i):
        p = F.trim(F.get(parts, F.lit(i)))
        return F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p.try_cast("double"))

    return F.coalesce(
        F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
        .when(F.size(parts) == 2, whole(0) * 60 + real(1))
        .when(F.size(parts) == 1, real(0)),
        F.lit(0.0))


def _rounded(seconds, scale: int) -> Column:
    return F.bround(_col(seconds) * F.lit(float(scale)), 0).cast("bigint")


def _clock(units: Column, scale: int, pattern: str, hours: bool = True) -> Column:
    frac = F.pmod(units, F.lit(scale))
    sec = F.expr("0").cast("bigint") + F.floor(units / scale)
    if hours:
        return F.format_string(pattern, F.floor(sec / 3600), F.pmod(F.floor(sec / 60), F.lit(60)),
                               F.pmod(sec, F.lit(60)), frac)
    return F.format_string(pattern, F.floor(sec / 60), F.pmod(sec, F.lit(60)), frac)


def srt_time(seconds) -> Column:
    return _clock(_rounded(seconds, 1000), 1000, "%02d:%02d:%02d,%03d")


def vtt_time(seconds) -> Column:
    return _clock(_rounded(seconds, 1000), 1000, "%02d:%02d:%02d.%03d")


def sbv_time(seconds) -> Column:
    return _clock(_rounded(seconds, 1000), 1000, "%d:%02d:%02d.%03d")


def ass_time(seconds) -> Column:
    return _clock(_rounded(seconds, 100), 100, "%d:%02d:%02d.%02d")


def lrc_time(seconds) -> Column:
    return _clock(_rounded(seconds, 100), 100, "%02d:%02d.%02d", hours=False)


# --- which text, which markup ---------------------------------------------------------

def cue_text(columns: Sequence[str], translated: bool = False) -> Column:
    """The text a writer shows: transliterated, else translated when asked for, else text."""
    order = ["transliterated"] + (["translated"] if translated else []) + ["text"]
    present = [F.col(c) for c in order if c in columns]
    return trim_ws(F.coalesce(*present, F.lit("")))


MARKUP = r"</?(?:[a-zA-Z][^<>]*|\d[\d:.]*)>|\{\\[^}]*\}"


def strip_tags(text) -> Column:
    """Remove styling tags, karaoke times and position tags, and collapse white space."""
    return collapse(F.regexp_replace(_col(text), MARKUP, ""))


def strip_ass(text) -> Column:
    """Remove ASS override tags; forced breaks become spaces."""
    plain = F.regexp_replace(_col(text), r"\{.*?\}", "")
    return trim_ws(F.regexp_replace(plain, r"\\[Nnh]", " "))


def vtt_escape(line) -> Column:
    out = F.replace(_col(line), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


# --- speech text ------------------------------------------------------------------------

def finish_sentence(text, language) -> Column:
    """Add the language's full stop when no closing mark ends the line."""
    t = trim_ws(text)
    stop = F.lit(".")
    for code, mark in K.FULL_STOPS.items():
        stop = F.when(_col(language) == code, mark).otherwise(stop)
    open_end = (t != "") & ~t.rlike(char_class(K.CLOSING_PUNCTUATION) + r"\z")
    return F.when(open_end, F.concat(t, stop)).otherwise(t)


def add_punctuation(text) -> Column:
    """Close a line with an ideographic full stop if it holds any CJK ideograph, else a dot."""
    t = trim_ws(text)
    open_end = (t != "") & ~t.rlike(char_class(K.CHUNK_END_MARKS) + r"\z")
    stop = F.when(t.rlike("[一-鿿]"), "。").otherwise(".")
    return F.when(open_end, F.concat(t, stop)).otherwise(t)


def line_limit(language, max_len: int = K.MAX_LINE_LENGTH) -> Column:
    """Characters per line for a language; scripts without spaces get a shorter line."""
    return F.when(is_no_space(language), min(max_len, K.NO_SPACE_MAX_LINE_LENGTH)).otherwise(max_len)


def letters(text) -> Column:
    return F.regexp_replace(_col(text), r"[^\p{L}]", "")
