"""Fixed values that results depend on: patterns, constants, letters, word lists and lexer rules. Everything else is an argument."""

from __future__ import annotations

import unicodedata

# --- fixed values: patterns -------------------------------------------------------------------
URL_PATTERN = r"https?:(?://|\\)+[\w:#@%/;$()~?+,\-.<=\\&]*"
SYMBOLS_TO_BLANK = "\\!?`^&$*()+=#<>~"
WORD_LISTS_SPLIT = r"[\d.,:;?^!~\[\](){}$&#'\"@|+\-/]+"
SYLLABLE_LISTS_SPLIT = r"[\s\d.,:;?^!~\[\](){}$&#'\"@|+\-/]+"
TREEBANK_MARKS = ("*E*", "*T*", "*E", "E*", "*T", "T*")
SENTENCE_END_MARKS = r"[.!?]"

# --- fixed values: constants of the models ----------------------------------------------------
MIN_TERM_LENGTH = 4
TOPIC_COUNTS = range(2, 10)
TERMS_PER_TOPIC = 15
EXTRA_DOCS_PER_TOPIC = 3
LDA_ITERATIONS = 50
HASH_BUCKETS = 100_000
MIN_DOC_FREQ = 5
CLASSIFIER_ITERATIONS = 100
POST_WEIGHT = 1.5
MIN_TRAINING_CHARS = 8
EM_EPSILON = 0.01
EM_ROUNDS = 11
RESOLVER_LAMBDA1 = 0.996
RESOLVER_LAMBDA2 = 0.004
PATH_TOLERANCE = 1e-4
UNKNOWN_SYLLABLE_WEIGHT = 100
SCORED_PARTS_OF_SPEECH = ("n", "a", "r", "v")

# --- fixed values: letters ---------------------------------------------------------------------
# The 12 Vietnamese vowels and the 5 tone marks; their 60 pairs give the composition table.
VOWELS = "aăâeêioôơuưy"
TONE_MARKS = "\u0301\u0300\u0309\u0303\u0323"
COMPOSED_LETTERS = [(v + t, unicodedata.normalize("NFC", v + t)) for v in VOWELS for t in TONE_MARKS]

# Tone mark moves to the second vowel.
TONE_MARK_RULES = [
    ("òa", "oà"), ("óa", "oá"), ("ỏa", "oả"), ("õa", "oã"), ("ọa", "oạ"),
    ("òe", "oè"), ("óe", "oé"), ("ỏe", "oẻ"), ("õe", "oẽ"), ("ọe", "oẹ"),
    ("ùy", "uỳ"), ("úy", "uý"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("ụy", "uỵ"),
]

# --- fixed values: word lists --------------------------------------------------------------------
# Titles that are split off a name.
NAME_PREFIXES = [
    "ông", "bà", "bác", "chú", "cô", "thím", "dì", "cậu", "cụ", "mợ", "ngài", "anh", "chị",
    "thằng", "cái", "vua", "tỉnh", "huyện", "xã", "phường", "bộ", "sở", "cục", "ban", "ngành",
    "theo",
]

# Words that announce a date part, with the rule-name part that may follow.
DATE_WORDS = {"day": ("ngày", "Ngày"), "month": ("tháng", "Tháng"), "year": ("năm", "Năm")}

# --- fixed values: lexer rules (name, pattern, first characters), earlier rule wins ties -----------
# Names and order are fixed; each pattern matches the same texts as its rule but is not written letter by letter like it. Groups don't
# capture, classes and date parts that recur are named once, and escapes without effect are left out. "number1" lacks optional
# digits that change nothing; "phrase" and "allcaps" hold one class for letters and blanks where nested repeats would try every split.
_LOWER = "aàảãáạăằẳẵắặâầẩẫấậbcdđeèẻẽéẹêềểễếệfghiìỉĩíịjklmnoòỏõóọôồổỗốộơờởỡớợpqrstuùủũúụưừửữứựvwxyỳỷỹýỵz"
_UPPER = "AÀẢÃÁẠĂẰẲẴẮẶÂẦẨẪẤẬBCDĐÐEÈẺẼÉẸÊỀỂỄẾỆFGHIÌỈĨÍỊJKLMNOÒỎÕÓỌÔỒỔỖỐỘƠỜỞỠỚỢPQRSTUÙỦŨÚỤƯỪỬỮỨỰVWXYỲỶỸÝỴZ"
_NAME_START = "A-ZÁÂĐÐÍÔƯỨÝỶ"
_DAY = "(?:[12][0-9]|3[01]|0*[1-9])"
_MONTH = "(?:1[012]|0*[1-9])"
_ANY_MONTH = "(?:1[012]||0*[1-9])"
_MONTH_FIRST = "(?:0*[1-9]|1[012])"
_DAY_SHORT_FIRST = "(?:0*[1-9]|[12][0-9]|3[01])"
_YEAR = r"(?:19|20)\d\d"
_DIGITS = "0-9"
_WORDISH = "A-Za-z0-9_"

LEXER_RULES = [
    ("numbersign", "#", "#"),
    ("ampersand", "&", "&"),
    ("date_mm-dd-yy", rf"{_MONTH_FIRST}-{_DAY_SHORT_FIRST}-\d\d", _DIGITS),
    ("date_mm/dd/yy", rf"{_MONTH_FIRST}/{_DAY_SHORT_FIRST}/\d\d", _DIGITS),
    ("date_mm.dd.yy", rf"{_MONTH_FIRST}\.{_DAY_SHORT_FIRST}\.\d\d", _DIGITS),
    ("date_dd-mm-yy", rf"{_DAY}-{_ANY_MONTH}-\d\d", _DIGITS),
    ("date_dd/mm/yy", rf"{_DAY}/{_ANY_MONTH}/\d\d", _DIGITS),
    ("date_dd.mm.yy", rf"{_DAY}\.{_ANY_MONTH}\.\d\d", _DIGITS),
    ("date_dd-mm-yyyy", rf"{_DAY}-{_ANY_MONTH}-{_YEAR}", _DIGITS),
    ("date_dd/mm/yyyy", rf"{_DAY}/{_ANY_MONTH}/{_YEAR}", _DIGITS),
    ("date_dd.mm.yyyy", rf"{_DAY}\.{_ANY_MONTH}\.{_YEAR}", _DIGITS),
    ("date_dd-mm", rf"{_DAY_SHORT_FIRST}[-/.]{_MONTH}", _DIGITS),
    ("date_mm-yy", rf"{_MONTH_FIRST}[-/.]\d\d", _DIGITS),
    ("date_mm-yyyy", rf"{_MONTH_FIRST}[-/.]{_YEAR}", _DIGITS),
    ("date_yyyy", _YEAR, _DIGITS),
    ("date_mm-dd-yyyy", rf"{_MONTH_FIRST}-{_DAY}-{_YEAR}", _DIGITS),
    ("date_mm/dd/yyyy", rf"{_MONTH_FIRST}/{_DAY}/{_YEAR}", _DIGITS),
    ("date_mm.dd.yyyy", rf"{_MONTH_FIRST}\.{_DAY}\.{_YEAR}", _DIGITS),
    ("date_yyyy-mm-dd", rf"{_YEAR}-{_MONTH_FIRST}-{_DAY}", _DIGITS),
    ("date_yyyy/mm/dd", rf"{_YEAR}/{_MONTH_FIRST}/{_DAY}", _DIGITS),
    ("date_yyyy.mm.dd", rf"{_YEAR}\.{_MONTH_FIRST}\.{_DAY}", _DIGITS),
    ("hhmmss", r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d", _DIGITS),
    ("percent", r"(?:[0-9]*[.,])?[0-9]+%", _DIGITS + ".,"),
    ("name1", f"[{_NAME_START}][{_LOWER}]*", _NAME_START),
    ("name2", rf"[{_NAME_START}][{_LOWER}]*(?:\s+[{_NAME_START}][{_LOWER}]+)*", _NAME_START),
    ("phrase", rf"[{_UPPER}]?[{_LOWER}\s]*[{_LOWER}]", _UPPER + _LOWER + r"\s"),
    ("allcaps", rf"[{_UPPER}](?:[{_UPPER}\s]*[{_UPPER}])?[^{_LOWER}/)(?!.;:,\-\"']", _UPPER),
    ("fraction", r"\d+/\d+", _DIGITS),
    ("email", r"\w[-.\w]*\w@\w[-.\w]*\w\.\w{2,3}", _WORDISH),
    ("return", "^$", ""),
    ("fslash", "/", "/"),
    ("langle", "<", "<"),
    ("xmltags", r"</*\w*>", "<"),
    ("equal", "=", "="),
    ("rangle", ">", ">"),
    ("aroba", "@", "@"),
    ("number1", r"\+?[0-9]+(?:[.,]\d+)*", _DIGITS + "+"),
    ("degree", r"[-+]?(?:[0-9]*[.,])?[0-9]+°", _DIGITS + r"\-+.,"),
    ("ponctuation", r"[\\?!.:;,\-\"']", r"\\?!.:;,\-\"'"),
    ("dollar", r"\$", "$"),
    ("lparen", r"\(", "("),
    ("rparen", r"\)", ")"),
    ("asterisk", r"\*", "*"),
    ("plus", r"\+", "+"),
    ("minus", "-", r"\-"),
    ("ellipsis", r"\.\.\.", "."),
    ("residual", r"\W", r"\W"),
    ("lbracket", r"\[", r"\["),
    ("bslash", r"\\", r"\\"),
    ("rbracket", r"\]", r"\]"),
    ("entity0", rf"\d+(?:[.,]\d+)*[A-Z{_LOWER}]+\d+$", _DIGITS),
    ("entity1", rf"[A-Z{_LOWER}]+\d*$", "A-Z" + _LOWER),
    ("entity2", rf"[A-Z{_LOWER}\d]+(?:[.\-/][A-Z{_LOWER}\d]+)*[A-Z{_LOWER}\d]+", "A-Z" + _LOWER + _DIGITS),
    ("space", r"\s+", r"\s"),
    ("word", r"\w", _WORDISH),
    ("lcbrace", r"\{", "{"),
    ("rcbrace", r"\}", "}"),
    ("underscore", "_", "_"),
    ("pound", "£", "£"),
]
