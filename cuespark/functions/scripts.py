"""Conversion between scripts.

Letter tables are applied with built-in string functions. Only the letter rules of Urdu to
Devanagari look at neighbours; they run in Arrow batches, once for each distinct word of a batch.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import script_tables as S
from .text import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def substitute(text: Column, table: dict[str, str]) -> Column:
    """Replace letters by strings: one-to-one ones in one pass, the others one by one, longest first."""
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) <= 1}
    for k in sorted((k for k in table if k not in single), key=len, reverse=True):
        text = F.replace(text, F.lit(k), F.lit(table[k]))
    kept = [k for k in single if single[k]] + [k for k in single if not single[k]]
    return F.translate(text, "".join(kept), "".join(single[k] for k in kept)) if single else text


def _by_word(text, marks: str, word) -> Column:
    """Apply `word(core, trailing)` to every run of non-space; white space stays as it is."""
    tokens = F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+|\s+"), F.lit(0))

    def one(t):
        core = F.rtrim(t, F.lit(marks))
        return F.when(t.rlike(r"(?U)^\s"), t).otherwise(word(core, F.substr(t, F.length(core) + 1)))

    return F.array_join(F.transform(tokens, one), "")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def urdu_to_roman(text) -> Column:
    """Urdu in Roman letters: known words as a whole, others letter by letter."""
    words = _lookup(S.URDU_ROMAN_WORDS)
    return _by_word(text, S.URDU_TRAILING_MARKS, lambda core, tail: F.concat(
        F.coalesce(words[core], substitute(core, S.URDU_ROMAN_LETTERS)), substitute(tail, S.URDU_ROMAN_LETTERS)))


def roman_to_urdu(text) -> Column:
    """Roman letters in Urdu: known words, then letter pairs, then letters."""
    words = _lookup({v: k for k, v in S.URDU_ROMAN_WORDS.items()})
    letters = S.ROMAN_PAIRS | S.ROMAN_LETTERS

    def word(core, tail):
        return let(F.lower(core), lambda c: F.concat(
            F.coalesce(words[c], substitute(c, letters)), substitute(tail, S.ROMAN_MARKS)))

    return _by_word(text, S.ROMAN_TRAILING_MARKS, word)


# --- scripts that share one block layout --------------------------------------------------------

# A letter that a script lacks is written by what its place stands for: the first of these places that is in use.
# Aspirated and voiced stops fall back to the first stop of their row.
def _stand_ins() -> dict[int, list[tuple[int, ...]]]:
    places: dict[int, list[tuple[int, ...]]] = {}
    for row in (0x15, 0x1A, 0x1F, 0x24, 0x2A):                  # rows of stops: plain, aspirated, voiced, both, nasal
        for k in range(1, 4):
            places[row + k] = [(row + 2,), (row,)] if k == 3 else [(row,)]
    long_e, long_o = (0x0F,), (0x13,)
    places |= {0x00: [(0x01,), (0x02,)], 0x01: [(0x02,)], 0x02: [(0x01,)], 0x0B: [(0x30, 0x3F)], 0x0C: [(0x32, 0x3F)],
               0x04: [(0x05,)], 0x0D: [long_e], 0x0E: [long_e], 0x11: [long_o], 0x12: [long_o], 0x19: [(0x28,)], 0x1E: [(0x28,)],
               0x29: [(0x28,)], 0x31: [(0x30,)], 0x33: [(0x32,)], 0x34: [(0x33,), (0x32,)], 0x35: [(0x2C,)], 0x36: [(0x38,)], 0x37: [(0x36,), (0x38,)],
               0x43: [(0x4D, 0x30, 0x3F)], 0x44: [(0x43,), (0x4D, 0x30, 0x40)], 0x45: [(0x47,)], 0x46: [(0x47,)], 0x49: [(0x4B,)], 0x4A: [(0x4B,)],
               0x58: [(0x15,)], 0x59: [(0x16,), (0x15,)], 0x5A: [(0x17,), (0x15,)], 0x5B: [(0x1C,)], 0x5C: [(0x21,), (0x1F,)], 0x5D: [(0x22,), (0x1F,)],
               0x5E: [(0x2B,), (0x2A,)], 0x5F: [(0x2F,)], 0x60: [(0x0B,), (0x30, 0x40)], 0x61: [(0x0C,), (0x32, 0x40)],
               0x3C: [()], 0x3D: [()]}                          # nukta and avagraha are left out
    return places


# Assamese ra and va, and the Gurmukhi nasal sign.
OWN_LETTERS = {"bn": {0x70: [(0x30,)], 0x71: [(0x35,), (0x2C,)]}, "pa": {0x70: [(0x02,)]}}


def _shift_table(source: str, target: str) -> dict[str, str]:
    """What each letter of a script becomes in another; letters without any counterpart are not in it."""
    a, b = S.BLOCKS[source], S.BLOCKS[target]
    stand_ins = _stand_ins()

    def used(block: int, place: int) -> bool:
        return unicodedata.category(chr(block + place)) != "Cn"

    table = {}
    for place in range(0x80):
        if place in (0x64, 0x65) or not used(a, place):         # dandas are shared by all scripts
            continue
        shared = [(place,)] if place < 0x70 else []              # the places behind are each script's own
        for way in [*shared, *stand_ins.get(place, []), *OWN_LETTERS.get(source, {}).get(place, [])]:
            if all(used(b, p) for p in way):
                table[chr(a + place)] = "".join(chr(b + p) for p in way)
                break
    return table


def shift_script(text, source: str, target: str) -> Column:
    """Letters at the same place of two script blocks stand for each other.

    No result holds an unassigned code point: a letter that the target lacks becomes its nearest
    counterpart, and one without any stays in its own script (`unconverted_letters` counts them).
    """
    return substitute(_col(text), _shift_table(source, target))


def unconverted_letters(text, source: str, target: str) -> Column:
    """How many letters and signs of an Indic text `shift_script` leaves as they are; null for null."""
    t, a = _col(text), S.BLOCKS[source]
    left = "".join(chr(a + p) for p in range(0x80) if p not in (0x64, 0x65) and chr(a + p) not in _shift_table(source, target))
    return (F.length(t) - F.length(F.translate(t, left, ""))).cast("long")


def devanagari_to_roman(text) -> Column:
    """Devanagari in the scholarly Roman alphabet; a bare consonant carries an a."""
    t = substitute(_col(text), {k: v + "a" for k, v in S.IAST_CONSONANTS.items()})
    t = substitute(t, {"a" + k: v for k, v in S.IAST_SIGNS.items()} | {"a्": ""})
    return substitute(t, S.IAST_VOWELS | S.IAST_MARKS)


def roman_to_devanagari(text) -> Column:
    virama = "्"
    t = substitute(F.lower(_col(text)), {v: k + virama for k, v in S.IAST_CONSONANTS.items()})
    signs = {v: k for k, v in S.IAST_SIGNS.items()}
    t = substitute(t, {virama + v: k for v, k in signs.items()} | {virama + "a": ""})
    return substitute(t, {v: k for k, v in S.IAST_VOWELS.items()} | {"ṃ": "ं", "ḥ": "ः"})


def indic_convert(text, source: str, target: str) -> Column:
    """Text from one Indic script (or Roman) into another, through Devanagari.

    Urdu output loses its short-vowel marks. Urdu input is converted by `urdu_to_devanagari`.
    """
    t = _col(text)
    t = roman_to_devanagari(t) if source == "roman" else t if source == "hi" else shift_script(t, source, "hi")
    if target == "roman":
        return devanagari_to_roman(t)
    if target == "ur":
        t = F.regexp_replace(t, "े(?=\\p{L}|\\p{M})", "ی")
        return F.regexp_replace(substitute(t, S.DEVANAGARI_URDU), "[ً-ْ]", "")
    return t if target == "hi" else shift_script(t, "hi", target)


# --- Urdu to Devanagari -----------------------------------------------------------------------------

# What a letter becomes depends on the sound before it (o: none yet, c: a consonant, v: a vowel) and on
# the letters after it. Rules are tried from the top: pattern, sounds before, result, sound it leaves
# ("" leaves the one before). A result may be a function of the match and of what was written last.
_CONSONANT = "[" + "".join(S.DEVANAGARI_CONSONANTS) + "]"
_LETTER_RULES = [(re.compile(pattern), before, result, leaves) for pattern, before, result, leaves in [
    (_CONSONANT + "ھ", "ocv", lambda m, last: S.DEVANAGARI_ASPIRATES.get(m[0], S.DEVANAGARI_CONSONANTS[m[0]] + "्ह"), "c"),
    (_CONSONANT, "ocv", lambda m, last: S.DEVANAGARI_CONSONANTS[m], "c"),
    ("ِ", "c", "ि", "v"), ("ِ", "ov", "इ", "v"),
    ("ُ", "c", "ु", "v"), ("ُ", "ov", "उ", "v"),
    ("آ", "c", "ा", "v"), ("آ", "ov", "आ", "v"),
    ("ے", "c", "े", "v"), ("ے", "ov", "ए", "v"),
    ("اِ", "o", "इ", "v"), ("اُ", "o", "उ", "v"), ("ای", "o", "ए", "v"), ("او", "o", "औ", "v"),
    ("ا", "o", "अ", "v"), ("ا", "c", "ा", "v"), ("ا", "v", "आ", "v"),
    ("و", "o", "व", "c"), ("و(?=[اآ])", "c", "व", "c"), ("و", "c", "ो", "v"), ("و", "v", "ओ", "v"),
    ("ی", "o", "य", "c"), ("ی(?=[اآو])", "cv", "य", "c"), (r"یں\Z", "c", "ें", "v"), ("ی", "c", "ी", "v"), ("ی", "v", "ई", "v"),
    ("ئیں", "ocv", "एँ", "v"), ("ئے", "ocv", "ए", "v"), ("ئی", "ocv", "ई", "v"), ("ئو", "ocv", "ओ", "v"), ("ئ", "ocv", "इ", "v"),
    ("ؤ", "ocv", "ओ", "v"),
    (r"ہ\Z", "c", "ा", "v"), ("ہ", "ocv", "ह", "c"), ("ھ", "ocv", "ह", "c"),
    ("عا", "o", "आ", "v"), ("ع", "o", "अ", "v"), (r"ع(?!\Z)", "c", "ा", "v"), ("ع", "cv", "", ""),
    ("ّ", "c", lambda m, last: "्" + last if last else "", ""), ("ّ", "ov", "", ""),
    ("ً", "ocv", "न", "c"), ("[َء]", "ocv", "", ""), ("ں", "ocv", "ं", ""),
]]


def devanagari_word(word: str) -> str:
    """One Urdu word by the letter rules; characters without a rule stay."""
    letters = "".join(c for c in word if c not in S.URDU_SILENT)
    written, before, at = [], "o", 0
    while at < len(letters):
        match, result, leaves = None, letters[at], ""
        for pattern, sounds, result_, leaves_ in _LETTER_RULES:
            match = pattern.match(letters, at) if before in sounds else None
            if match:
                result, leaves = result_, leaves_
                break
        if callable(result):
            result = result(match[0], written[-1] if written else "")
        if result:
            written.append(result)
        before, at = leaves or before, match.end() if match else at + 1
    return "".join(written)


_MARKS = S.URDU_MARKS | {chr(b + d): str(d) for b in (0x06F0, 0x0660) for d in range(10)}
_OUTSIDE = "‌‍"


def devanagari_run(run: str) -> str:
    """A run of Urdu characters: its word, between the marks and digits it begins and ends with."""
    core = "".join(c for c in run if c not in _MARKS and c not in _OUTSIDE)
    head = run[:len(run) - len(run.lstrip("".join(_MARKS)))]
    lead = "".join(_MARKS[c] for c in head)
    if not core:
        return lead
    tail = run[len(run.rstrip("".join(_MARKS))):]
    return lead + S.DEVANAGARI_WORDS.get(core, devanagari_word(core)) + "".join(_MARKS[c] for c in tail)


URDU_RUN = "[؀-ۿݐ-ݿ‌‍]"
_RUNS = re.compile(URDU_RUN + "+")
# The blank before a future ending, a word of its own in Urdu that Devanagari writes with its verb.
_GLUE = re.compile("(?<=[^ ]) (?=(?:" + "|".join(S.FUTURE_ENDINGS) + ")[۔،؟।,?.!]*(?: |$))")


class _Once(dict):
    """Results of a function by argument, so that each distinct one is computed once."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self[key] = self.of(key)
        return value


def _rewritten(pattern: re.Pattern, of, pieces=lambda text: [text]):
    """A function on batches of texts that puts of(match) for every match, converting each distinct match of a batch once."""
    def run(texts: pd.Series) -> pd.Series:
        known = _Once(of)
        return texts.map(lambda t: None if t is None else "".join(pattern.sub(lambda m: known[m[0]], p) for p in pieces(t)))

    return F.pandas_udf(run, StringType())


def urdu_to_devanagari(texts: DataFrame, keys=("track_id", "id"), text: str = "text") -> DataFrame:
    """(keys, converted): Urdu written in Devanagari; whatever is not Urdu passes through. No shuffle.

    Entries of two words are found first. A future ending, a word of its own in Urdu, joins the
    word before it; Devanagari that was in the text stays as it is.
    """
    u = substitute(F.col(text), S.URDU_VARIANTS)
    for k, v in S.DEVANAGARI_WORDS.items():
        if " " in k:
            u = F.regexp_replace(u, f"(?<![^ ]){k}(?![^ ])", v)
    convert = _rewritten(_RUNS, devanagari_run, _GLUE.split)
    return texts.select(*keys, convert(u).alias("converted"))


# --- numbers --------------------------------------------------------------------------------------------

def _by_scale(n: int, scales):
    """How many of each scale a number has, with the scale's name, and the rest without one; those it has."""
    for scale, name in [*scales, (1, "")]:
        count, n = divmod(n, scale)
        if count:
            yield count, name


def hindi_number(n: int) -> str:
    words = [f"{hindi_number(k)} {name}" if name else S.HINDI_NUMBERS[k - 1] for k, name in _by_scale(n, S.HINDI_SCALES)]
    return " ".join(words) or S.HINDI_ZERO


def kanji_number(n: int) -> str:
    def below_ten_thousand(m: int) -> str:      # a one before a scale is not written
        return "".join(("" if name and k == 1 else S.KANJI_DIGITS[k]) + name for k, name in _by_scale(m, S.KANJI_SMALL))

    return "".join(below_ten_thousand(k) + name for k, name in _by_scale(n, S.KANJI_LARGE)) or S.KANJI_DIGITS[0]


def spell_numbers(texts: DataFrame, language: str, keys=("track_id", "id"), text: str = "text") -> DataFrame:
    """(keys, converted): every run of digits in Hindi words (hi) or kanji numerals (ja). No shuffle."""
    spelled = kanji_number if language == "ja" else hindi_number
    convert = _rewritten(re.compile(r"\d+"), lambda run: spelled(int(run)))
    return texts.select(*keys, convert(F.col(text)).alias("converted"))
