import unicodedata

from pyspark.sql import functions as F
import pytest

from cuespark.functions import chunks, script_tables as S, scripts, text as T
from cuespark.functions.python_text import common_length, spoken_form
from cuespark.functions.spread import distribute_text
from cuespark.functions.wrap import wrap_text
from cuespark.operators.build import text_ends_sentence
from cuespark.sources import subtitles

ENDS = {'He said "stop."': True, "کیا حال ہے؟": True, "and then,": False, "I spoke with Dr.": False,
        "for example, e.g.": False, "John F.": False, "(Mr.": False, "No.": True, "That was me, I.": True,
        "I got an A.": True, "We waited...": True, "Version 2.": True, "": False, ". ": True}


def test_ends_sentence(one):
    assert one(T.ends_sentence, *ENDS) == list(ENDS.values())
    assert [text_ends_sentence(t) for t in ENDS if t.strip() != "."] == [v for k, v in ENDS.items() if k.strip() != "."]


def test_wrap(one):
    long = " ".join(f"word{i}" for i in range(40))
    short, two, many, solid, blank = one(
        wrap_text, "Hello there", "one two three four five six seven eight nine ten eleven", long, "x" * 50, "   ")
    assert short == ["Hello there"] and blank == []
    assert len(two) == 2 and abs(len(two[0]) - len(two[1])) <= 10
    assert " ".join(many) == long and all(len(x) <= 42 for x in many)
    assert "".join(solid) == "x" * 50 and all(len(x) <= 42 for x in solid)


def test_wrap_long_word_inside_text(one):
    [lines] = one(lambda c: wrap_text(c, 20, 2), "short " + "y" * 45 + " tail of the text that goes on")
    assert "".join(lines).replace(" ", "").count("y") == 45 and all(len(x) <= 20 for x in lines)


@pytest.mark.parametrize("text, weights, solid, parts", [
    ("a b c d", [1, 1], False, ["a b", "c d"]),
    ("uno dos, tres cuatro cinco", [1, 1], False, ["uno dos,", "tres cuatro cinco"]),
    (" hola mundo ", [5], False, ["hola mundo"]),
    ("abcd", [1, 1], True, ["ab", "cd"]),
])
def test_distribute(spark, text, weights, solid, parts):
    d = spark.createDataFrame([(text, weights)], "text string, w array<long>")
    assert d.select(distribute_text("text", "w", F.lit(solid))).first()[0] == parts


def test_distribute_gives_every_part_a_word_while_it_can(spark):
    d = spark.createDataFrame([("one two three", [100, 1, 1]), ("hola", [1, 1, 1])], "text string, w array<long>")
    a, b = [r[0] for r in d.select(distribute_text("text", "w", F.lit(False))).collect()]
    assert all(a) and " ".join(a) == "one two three"
    assert "".join(b) == "hola" and len(b) == 3


def test_times(one):
    assert one(T.to_seconds, "00:01:02,500", "01:02.500", "2.5", "aa:bb:cc", "", "1:2:3:4") == [62.5, 62.5, 2.5, 0, 0, 0]


def test_markup(spark):
    docs = spark.createDataFrame([
        ("a.srt", "1\n00:00:00,000 --> 00:00:02,000\n{\\an8}<i>Hello</i> <font color=\"#ff0\">world</font>.\n"),
        ("b.vtt", "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\n<v Roger>Rock <00:00:01.000><c.loud>&amp; roll</c>\n"),
        ("c.srt", "1\r\n00:00:00,000 --> 00:00:02,000\r\n3 < 5 and {braces} stay\r\n"),
        ("d.srt", "1\n00:00:00,000 --> 00:00:02,000\n<i></i>\n\n2\n00:00:03,000 --> 00:00:04,000\nHi\n"),
        ("e.txt", "x"), ("f.srt", "1\n00:00 -->\nx\n\n2\n00:00:03,000 --> 00:00:04,000\nHi\n")], "path string, value string")
    cues, errors = subtitles.read_subtitles(docs)
    rows = {(r.path, r.id): r.text for r in cues.collect()}
    assert rows == {("a.srt", 0): "Hello world.", ("b.vtt", 0): "Rock & roll",
                    ("c.srt", 0): "3 < 5 and {braces} stay", ("d.srt", 1): "Hi"}
    assert sorted(r.path for r in errors.collect()) == ["e.txt", "f.srt"]


def parsed(spark, fmt, value):
    d = spark.createDataFrame([("p." + fmt, value)], "path string, value string")
    return [(r.id, r.start, r.end, r.text) for r in subtitles.parse(d, fmt).orderBy("id").collect()]


def test_formats(spark):
    two = [(0, 0.0, 2.5, "Hello world."), (1, 3.0, 5.75, "This is a test.")]
    assert parsed(spark, "srt", "1\n00:00:00,000 --> 00:00:02,500\nHello world.\n\n2\n00:00:03,000 --> 00:00:05,750\nThis is a test.\n\n\n3\nNot a time\nx\n") == two
    assert parsed(spark, "sbv", "0:00:00.000,0:00:02.500\nHello world.\n\n0:00:03.000,0:00:05.750\nThis is a test.\n") == two
    assert parsed(spark, "lrc", "[00:00.00]Hello\n[00:03.00]\n[00:04.00]World\n") == [(0, 0.0, 4.0, "Hello"), (1, 4.0, 8.0, "World")]
    ass = "[Events]\nDialogue: 0,0:00:00.00,0:00:02.50,Default,,0,0,0,,{\\an8}Hello, world.\nDialogue: 0,0:00:03.00,0:00:05.75,Default,,0,0,0,,Line one\\NLine two\n"
    assert parsed(spark, "ass", ass) == [(0, 0.0, 2.5, "Hello, world."), (1, 3.0, 5.75, "Line one Line two")]
    vtt = "WEBVTT\n\nNOTE\nA comment.\n\n01:02.500 --> 01:05.000 position:10%\nShort.\n"
    assert parsed(spark, "vtt", vtt) == [(0, 62.5, 65.0, "Short.")]
    assert parsed(spark, "vtt", "WEBVTT\n") == []


def test_scripts(one):
    assert one(scripts.urdu_to_roman, "کیا حال ہے", "زبان", "کیا   حال", "کیا؟", "") == ["kya haal hai", "zban", "kya   haal", "kya?", ""]
    assert one(scripts.roman_to_urdu, "kya haal hai", "zar", "khan", "baat", "KYA", "kya?") == [
        "کیا حال ہے", "زار", "خان", "بآت", "کیا", "کیا؟"]
    assert one(lambda c: scripts.indic_convert(c, "bn", "roman"), "নমস্তে") == ["namaste"]
    assert one(lambda c: scripts.indic_convert(c, "hi", "ur"), "नमस्ते") == ["نمستے"]


def test_script_blocks_have_no_holes(one):
    """Every assigned letter of every block into every other script: only assigned code points come out."""
    for a in S.BLOCKS:
        letters = "".join(chr(S.BLOCKS[a] + p) for p in range(0x80) if unicodedata.category(chr(S.BLOCKS[a] + p)) != "Cn")
        for b in S.BLOCKS:
            if a != b:
                table = scripts._shift_table(a, b)
                assert all(unicodedata.category(c) != "Cn" for v in table.values() for c in v)
                assert sum(c not in table for c in letters if unicodedata.category(c) in ("Lo", "Nd")) <= 32
    assert one(lambda c: scripts.shift_script(c, "hi", "ta"), "भारत", "गंगा", "कृपा", "।") == ["பாரத", "கஂகா", "க்ரிபா", "।"]
    assert one(lambda c: scripts.shift_script(c, "hi", "pa"), "ऋषि", "भाषा") == ["ਰਿਸ਼ਿ", "ਭਾਸ਼ਾ"]
    assert one(lambda c: scripts.unconverted_letters(c, "hi", "bn"), "भारत", "ॻ", "", None) == [0, 1, 0, None]


def test_urdu_to_devanagari(spark):
    cases = {"یہ ایک مکمل دوستانہ کورس ہے۔": "ये एक मुकम्मल दोसताना कोर्स है।", "میرا نام": "मेरा नाम", "کھانا": "खाना",
             "بھائی": "भाई", "اِس": "इस", "لیں": "लें", "آپ": "आप", "کریں گے۔": "करेंगे।", "وہ ہوں گے": "वो होंगे",
             "ML Ops ۰ سے ہیرو، ٹھیک؟": "ML Ops 0 से हीरो, ठीक?"}
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(cases)], "track_id long, id long, text string")
    assert [r.converted for r in scripts.urdu_to_devanagari(d).orderBy("id").collect()] == list(cases.values())


@pytest.mark.parametrize("lang, cases", [
    ("hi", {"7": "सात", "19": "उन्नीस", "99": "निन्यानवे", "100": "एक सौ", "2024": "दो हज़ार चौबीस", "150000": "एक लाख पचास हज़ार",
            "30000000": "तीन करोड़", "0": "शून्य", "ML Ops 0 से हीरो, भाग 2": "ML Ops शून्य से हीरो, भाग दो"}),
    ("ja", {"0": "零", "10": "十", "15": "十五", "111": "百十一", "2024": "二千二十四", "10000": "一万",
            "123456789": "一億二千三百四十五万六千七百八十九"})])
def test_numbers(spark, lang, cases):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(cases)], "track_id long, id long, text string")
    assert [r.converted for r in scripts.spell_numbers(d, lang).orderBy("id").collect()] == list(cases.values())


def test_spoken_form():
    assert spoken_form("Hello, World!", "en") == "hello world"
    assert spoken_form("يہ ايک", "ur") == spoken_form("یہ ایک", "ur")
    assert spoken_form("Café déjà", "fr") == "cafe deja"


def test_common_length():
    def slow(a, b):
        if not a or not b:
            return 0
        return slow(a[1:], b[1:]) + 1 if a[0] == b[0] else max(slow(a[1:], b), slow(a, b[1:]))
    for a, b in (("abcde", "ace"), ("", "x"), ("aabba", "abab"), ("xyz", "abc")):
        assert common_length(a, b) == slow(a, b)


def test_chunks():
    assert chunks.speech_pieces("One two three. Four five six seven eight nine ten.", 20) == [
        "One two three.", "Four five six seven", "eight nine ten."]
    text = "Hello Mr. Smith, how are you? Fine.\" Ok then, it is done; good bye!"
    for size in (10, 25, 60):
        assert "".join(chunks.punctuation_chunks(text, size)).replace(" ", "") == text.replace(" ", "")
    assert "Mr." not in [c[-3:] for c in chunks.punctuation_chunks(text, 10)]
