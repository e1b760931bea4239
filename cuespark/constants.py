"""Fixed values.

Everything in this module is a fixed value: results only agree with the published
behaviour when these are exactly what they are, so they are kept together, plainly.
"""

# --- cue layout -----------------------------------------------------------------
MAX_LINE_LENGTH = 42
MAX_LINES = 2
MIN_CUE_SECONDS = 0.5
MAX_CUE_SECONDS = 7.0
PAUSE_SPLIT_SECONDS = 0.8
READING_CPS = 17.0
NO_SPACE_LANGUAGES = ["zh", "ja", "th", "my", "lo", "km"]
NO_SPACE_MAX_LINE_LENGTH = 16

SENTENCE_END = ".?!…。？！؟۔।"
CLAUSE_END = ",;:–—،，、"
CLOSING_MARKS = "\"')]}”’»"
OPENING_MARKS = "(\"'“‘«"
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "sra", "jr", "st", "vs", "e.g", "i.e", "approx",
    "fig", "nr", "bzw", "z.b", "ca", "mme", "mlle", "dra",
]
CONNECTIVES = [
    "and", "but", "or", "so", "because", "that", "which", "who", "when", "while", "if",
    "to", "with", "for", "from", "of", "in", "on", "at", "after", "before",
    "aur", "lekin", "ke", "ki", "ko", "se", "mein", "اور", "لیکن",
]
SENTENCE_CLOSE_SHARE = 0.5
MIN_SENTENCE_BREAK_SHARE = 0.15
MIN_CLAUSE_BREAK_SHARE = 0.3
CARRY_SHARE = 0.5
UNIT_MAX_CHARS = 300
UNIT_MAX_GAP_SECONDS = 2.0
LRC_LAST_LINE_SECONDS = 4.0

# --- speakers -------------------------------------------------------------------
MIN_EMBED_SECONDS = 1.0
SAME_SPEAKER_SIMILARITY = 0.5
MIN_SPEAKER_SECONDS = 4.0
REFERENCE_SECONDS = 12.0
REFERENCE_PAD_SECONDS = 0.25
MAX_EMBEDDED_CUES = 300
MAX_SPEAKERS = 6

# --- laying speech on a timeline --------------------------------------------------
TRACK_RATE = 48000
LAST_CUE_TAIL_SECONDS = 1.0
RETAKES = 2
MAX_DELAY_SECONDS = 1.0
MAX_SPEEDUP = 1.35

# --- meaning check ----------------------------------------------------------------
LATIN_TARGETS = ["de", "en", "es", "fr", "pt", "tr"]
TERM_PATTERN = r"https?://\S+|\S+@\S+\.\S+|\b[A-Z][a-z]+[A-Z]\w*\b|\b[A-Z]{2,}\b"
# The same where only ASCII letters, digits and _ make a word and only ASCII blanks end one, as in SQL engines without Unicode classes.
ASCII_TERM_PATTERN = (TERM_PATTERN.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))").replace(r"\w*", "[0-9A-Za-z_]*")
                      .replace(r"\w", "[0-9A-Za-z_]").replace(r"\S", r"[^\t\n\f\r ]"))
WRONG_SCRIPT_PENALTY = 0.3
LENGTH_PENALTY = 0.15
LOST_TERM_PENALTY = 0.05
LENGTH_RATIO = (0.35, 3.0)
DOUBT_THRESHOLD = 0.62
LENGTH_TOLERANCE = 0.03
SECONDS_PER_CHAR = {
    "ar": 0.0815, "de": 0.0697, "en": 0.0721, "es": 0.0664, "fr": 0.0472, "hi": 0.0831,
    "ja": 0.2357, "ko": 0.1561, "pt": 0.08, "ru": 0.0634, "tr": 0.0704, "ur": 0.0781,
    "zh": 0.2022,
}
PROMPT_LANGUAGE_NAMES = {
    "ar": "Arabic", "de": "German", "en": "English", "es": "Spanish", "fr": "French",
    "hi": "Hindi", "ja": "Japanese", "ko": "Korean", "pt": "Portuguese", "ru": "Russian",
    "tr": "Turkish", "ur": "Urdu", "zh": "Chinese",
}
PROMPT_CHINESE_NAMES = {
    "ar": "阿拉伯语", "de": "德语", "en": "英语", "es": "西班牙语", "fr": "法语", "hi": "印地语",
    "ja": "日语", "ko": "韩语", "pt": "葡萄牙语", "ru": "俄语", "tr": "土耳其语", "ur": "乌尔都语",
    "zh": "中文",
}

# --- line check -------------------------------------------------------------------
FAILED_CER = 0.5
RUN_ON = 0.3
UNSPACED_LANGUAGES = ["ja", "zh"]
KEEP_MARKS_LANGUAGES = ["hi", "ko", "ja"]
LATIN_WORD_PATTERN = r"[A-Za-z][A-Za-z0-9'.-]*"
ARABIC_FOLD_FROM = "يىكەۀ"
ARABIC_FOLD_TO = "ییکہہ"
ARABIC_FOLD_DROP = "ٔـ"

# --- runaway takes ----------------------------------------------------------------
RUNAWAY_SECONDS_PER_CHAR = 0.09
RUNAWAY_MIN_EXPECTED = 0.8
RUNAWAY_FACTOR = 1.8
RUNAWAY_MARGIN = 0.5
RUNAWAY_CAP = 1.3

# --- voice prompt -----------------------------------------------------------------
PROMPT_SECONDS = 10.0
PROMPT_GAP = 0.2
PROMPT_EDGE = 0.1
PROMPT_ROOM = (0.05, 0.08)
PROMPT_MIN_PIECE = 1.0

# --- calibration ------------------------------------------------------------------
CER_FACTOR = 1.5
NATURAL_RATE = (0.87, 1.15)

# --- files ------------------------------------------------------------------------
VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "ts", "m2ts"]
AUDIO_EXTENSIONS = ["mp3", "wav", "m4a", "flac", "aac", "ogg", "wma"]
SUBTITLE_EXTENSIONS = ["srt", "vtt", "lrc", "ass", "ssa", "sbv"]
SUPPORTED_LANGUAGES = [
    "ar", "zh", "en", "fr", "de", "hi", "ja", "ko", "pt", "ru", "es", "tr", "ur",
]
LANGUAGE_NAMES = {
    "ar": "Arabic", "zh": "Chinese", "en": "English", "fr": "French", "de": "German",
    "hi": "Hindi", "ja": "Japanese", "ko": "Korean", "pt": "Portuguese", "ru": "Russian",
    "es": "Spanish", "tr": "Turkish", "ur": "Urdu",
}
SUBTITLE_TAGS = ["forced", "sdh", "cc"]
LANGUAGE_WORDS = {
    "ara": "ar", "chi": "zh", "zho": "zh", "eng": "en", "fre": "fr", "fra": "fr", "ger": "de",
    "deu": "de", "hin": "hi", "jpn": "ja", "kor": "ko", "por": "pt", "rus": "ru", "spa": "es",
    "tur": "tr", "urd": "ur",
    "arabic": "ar", "chinese": "zh", "mandarin": "zh", "english": "en", "french": "fr",
    "german": "de", "hindi": "hi", "japanese": "ja", "korean": "ko", "portuguese": "pt",
    "russian": "ru", "spanish": "es", "turkish": "tr", "urdu": "ur",
}
LATIN_SCRIPT_LANGUAGES = [
    "af", "az", "ca", "cs", "cy", "da", "de", "en", "es", "et", "eu", "fi", "fr", "ga", "gl",
    "hr", "ht", "hu", "id", "is", "it", "jw", "la", "lb", "lt", "lv", "mi", "ms", "mt", "nl",
    "nn", "no", "pl", "pt", "ro", "sk", "sl", "sn", "so", "sq", "sv", "sw", "tk", "tl", "tr",
    "uz", "vi", "yo",
]
SCRIPT_CODES = ["roman", "ur", "hi", "bn", "gu", "pa", "ta", "te", "kn", "ml", "or", "si", "th", "my"]
NEURAL_SCRIPT_PAIRS = [("ur", "roman"), ("roman", "ur")]
NEURAL_HINDI_SOURCES = ["hi", "pa"]

# --- speech text ------------------------------------------------------------------
CLOSING_PUNCTUATION = ".!?…。！？؟।۔,;:،，、\"')]»”’"
FULL_STOPS = {"hi": "।", "ur": "۔", "ja": "。", "zh": "。"}
SPEECH_SENTENCE_END = ".!?。！？؟।"
CHUNK_SPLIT_MARKS = ".,;:!?。，；：！？"
CHUNK_CLOSING_MARKS = "\"'“”‘’）]》>」】"
CHUNK_END_MARKS = ";:,.!?…)]}\"'“”‘’；：，。！？、）】"
CHUNK_ABBREVIATIONS = [
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "Rev.", "Fr.", "Hon.", "Pres.", "Gov.",
    "Capt.", "Gen.", "Sen.", "Rep.", "Col.", "Maj.", "Lt.", "Cmdr.", "Sgt.", "Cpl.", "Co.",
    "Corp.", "Inc.", "Ltd.", "Est.", "Dept.", "St.", "Ave.", "Blvd.", "Rd.", "Mt.", "Ft.", "No.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.", "i.e.",
    "e.g.", "vs.", "Vs.", "Etc.", "approx.", "fig.", "def.",
]

# --- speaking weight of characters (relative to one Latin letter) -------------------
WEIGHTS = {
    "cjk": 3.0, "hangul": 2.5, "kana": 2.2, "ethiopic": 3.0, "yi": 3.0, "indic": 1.8,
    "thai_lao": 1.5, "khmer_myanmar": 1.8, "arabic": 1.5, "hebrew": 1.5, "latin": 1.0,
    "cyrillic": 1.0, "greek": 1.0, "armenian": 1.0, "georgian": 1.0, "punctuation": 0.5,
    "space": 0.2, "digit": 3.5, "mark": 0.0, "default": 1.0,
}
# Last code point of each run of blocks that share a weight, in code point order.
WEIGHT_BLOCKS = [
    (0x02AF, "latin"), (0x03FF, "greek"), (0x052F, "cyrillic"), (0x058F, "armenian"),
    (0x05FF, "hebrew"), (0x08FF, "arabic"), (0x0DFF, "indic"), (0x0EFF, "thai_lao"),
    (0x0FFF, "indic"), (0x109F, "khmer_myanmar"), (0x10FF, "georgian"), (0x11FF, "hangul"),
    (0x139F, "ethiopic"), (0x177F, "default"), (0x17FF, "khmer_myanmar"), (0x18FF, "default"),
    (0x19DF, "indic"), (0x19FF, "khmer_myanmar"), (0x1C7F, "indic"), (0x1C8F, "cyrillic"),
    (0x1CBF, "georgian"), (0x1CFF, "indic"), (0x1DBF, "latin"), (0x1DFF, "default"),
    (0x1EFF, "latin"), (0x30FF, "kana"), (0x312F, "cjk"), (0x318F, "hangul"), (0x9FFF, "cjk"),
    (0xA4CF, "yi"), (0xA63F, "default"), (0xA69F, "cyrillic"), (0xA6FF, "default"),
    (0xA7FF, "latin"), (0xA82F, "indic"), (0xA87F, "default"), (0xA95F, "indic"),
    (0xA97F, "hangul"), (0xA9DF, "indic"), (0xA9FF, "khmer_myanmar"), (0xAA5F, "indic"),
    (0xAA7F, "khmer_myanmar"), (0xAAFF, "indic"), (0xAB2F, "ethiopic"), (0xAB6F, "latin"),
    (0xABBF, "default"), (0xABFF, "indic"), (0xD7AF, "hangul"), (0xFAFF, "cjk"),
    (0xFDFF, "arabic"), (0xFE6F, "default"), (0xFEFF, "arabic"), (0xFFEF, "latin"),
]
UPPER_CJK_FROM = 0x20000
DEFAULT_REFERENCE_TEXT = "Nice to meet you."
DEFAULT_REFERENCE_TOKENS = 25

# --- routes between languages: (source, target) -> model, target token ----------------
PIVOT_LANGUAGE = "en"
LEGS = [
    ("en", "ar", "en-ar", ">>ara<<"), ("en", "de", "en-de", ">>deu<<"), ("en", "es", "en-es", ""),
    ("en", "fr", "en-fr", ""), ("en", "hi", "en-iir", ">>hin<<"), ("en", "pt", "en-pt", ">>por<<"),
    ("en", "ru", "en-ru", ">>rus<<"), ("en", "tr", "en-tr", ""), ("en", "ur", "en-iir", ">>urd<<"),
    ("ar", "en", "ar-en", ""), ("de", "en", "de-en", ""), ("es", "en", "roa-en", ""),
    ("fr", "en", "fr-en", ""), ("hi", "en", "inc-en", ""), ("ja", "en", "ja-en", ""),
    ("pt", "en", "roa-en", ""), ("ru", "en", "ru-en", ""), ("tr", "en", "tr-en", ""),
    ("ur", "en", "inc-en", ""), ("zh", "en", "zh-en", ""),
]
DIRECT_SOURCES = ["ja", "ko"]
DIRECT_TARGETS = ["ja", "ko", "zh"]
GRADES = ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F+", "F", "unrated"]
