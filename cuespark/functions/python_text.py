"""The few text functions Spark has no built-in for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .. import constants as K


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Decode HTML entities."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(StringType())
def nfkc_normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfd_normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


@F.pandas_udf(StringType())
def nfc_normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


_FOLD = {ord(a): b for a, b in zip(K.ARABIC_FOLD_FROM, K.ARABIC_FOLD_TO)} | {ord(c): None for c in K.ARABIC_FOLD_DROP}


_ASCII_MARKS = {c: " " for c in range(32, 127) if not chr(c).isalnum()}


class Bare(dict):
    """What each character becomes: marks, symbols and blanks a space, and accents nothing unless they are kept."""

    def __init__(self, keep_accents: bool):
        super().__init__()
        self.keep_accents = keep_accents

    def __missing__(self, c: int):
        kind = unicodedata.category(chr(c))
        self[c] = out = (c if self.keep_accents else None) if kind == "Mn" else " " if kind[0] in "PSZ" else c
        return out


_BARE = {keep: Bare(keep) for keep in (False, True)}


def spoken_form(text: str, language: str) -> str:
    """Text as speech carries it: no case, punctuation, marks or odd spacing."""
    if text.isascii():
        plain = text.lower().translate(_ASCII_MARKS)
    else:
        folded = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
        bare = unicodedata.normalize("NFD", folded).translate(_BARE[language in K.KEEP_MARKS_LANGUAGES])
        plain = unicodedata.normalize("NFC", bare)
    return ("" if language in K.UNSPACED_LANGUAGES else " ").join(plain.split())


@F.pandas_udf(StringType())
def normalize_speech(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else spoken_form(t, l or "") for t, l in zip(text, language)], dtype=object)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with Python integers as bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, with Python integers as bit columns.

    It is never below the difference of the lengths, and that is it when the shorter text is contained in the longer one,
    letter for letter in order: a transcript that only drops or only repeats something is told by one scan.
    """
    if len(a) > len(b):
        a, b = b, a
    letters = iter(b)
    if all(c in letters for c in a):
        return len(b) - len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = full, 0                # rows where the distance goes up, or down, by one from the row above
    for c in b:
        same = where.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | ~(across | more), more & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, same = (up << 1) | 1, same | less
        more, less = ((down << 1) | ~(same | up)) & full, up & same & full
    return distance


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("h", "r", "distance", "common")]))
def speech_pair(heard: pd.Series, text: pd.Series, language: pd.Series, common: pd.Series) -> pd.DataFrame:
    """Lengths of both texts in spoken form without spaces, and their edit distance or, where `common` is set, the length of
    their longest common subsequence. A null text has no length and no distance, and nothing in common."""
    rows = []
    for x, y, l, c in zip(heard, text, language, common):
        h, r = (None if t is None else spoken_form(t, l or "").replace(" ", "") for t in (x, y))
        both = h is not None and r is not None
        rows.append((None if h is None else len(h), None if r is None else len(r), edit_distance(h, r) if both and not c else None,
                     common_length(h or "", r or "") if c else None))
    return pd.DataFrame(rows, columns=["h", "r", "distance", "common"], dtype="Int32")
