"""Fixed values.

Every value below must equal the behaviour being reproduced for results to
match; they are stated plainly and together on purpose.
"""

# --- fixed values: punctuation normalisation (one code point to one) -------
PUNCT_MAP = {
    "’": "'",  # right single quote
    "´": "'",  # acute accent
    "‘": "'",  # left single quote
    "′": "'",  # prime
    "`": "'",
    "“": '"',  # left double quote
    "”": '"',  # right double quote
    "˝": '"',  # double acute accent
    "¨": '"',  # diaeresis
    "„": '"',  # low double quote
    "『": '"',  # white corner bracket, left
    "』": '"',  # white corner bracket, right
    "–": "-",  # en dash
    "—": "-",  # em dash
    "―": "-",  # horizontal bar
    "¬": "-",  # not sign
    "、": ",",  # ideographic comma
    "，": ",",  # fullwidth comma
    "：": ":",  # fullwidth colon
    "；": ";",  # fullwidth semicolon
    "？": "?",  # fullwidth question mark
    "！": "!",  # fullwidth exclamation mark
    "ِ": " ",  # arabic kasra
    "​": " ",  # zero width space
}
PUNCT_FROM = "".join(PUNCT_MAP.keys())
PUNCT_TO = "".join(PUNCT_MAP.values())

# --- fixed values: paragraph merging ---------------------------------------
SHORT_LINE_MAX = 25        # a line whose stripped length is at most this is short
MAX_LEADING_SHORT = 5      # at most this many leading short lines join the next line
LONG_PARAGRAPH_LIMIT = 2000  # overlong paragraph report threshold

# --- fixed values: M2 format -----------------------------------------------
FIELD_SEP = "|||"
NOOP_TYPE = "noop"
NONE_TOKEN = "-NONE-"
REQUIRED = "REQUIRED"

# --- fixed values: labels ----------------------------------------------------
SELECTED_LABELS = ["R:VERB", "R:NOUN", "R:ADJ", "R:ADV"]
CONTENT_TAGS = ["VERB", "NOUN", "ADJ", "ADV"]
LABEL_TRUE, LABEL_FALSE, LABEL_NONE = "true", "false", "NONE"

# --- fixed values: lexicons --------------------------------------------------
PSY_POS_MAP = {"Noun": "NOUN", "Verb": "VERB", "Adjective": "ADJ", "Adverb": "ADV"}
CEFR_J_POS_MAP = {
    "noun": "NOUN",
    "verb": "VERB",
    "adjective": "ADJ",
    "adverb": "ADV",
    "be-verb": "VERB",
    "do-verb": "VERB",
    "have-verb": "VERB",
}
CEFR_LEVELS = {"A1": 0, "A2": 1, "B1": 2, "B2": 3, "C1": 4, "C2": 5}
UNKNOWN_TAG = "X"

# --- fixed values: merge strategies ------------------------------------------
STRATEGIES = ["all-split", "all-merge", "all-equal"]

# --- fixed values: splits ----------------------------------------------------
TEST_SHARE = 0.1
SPLIT_SEED = 1848

# --- fixed values: character classes ----------------------------------------
# Python's str whitespace (what `\s` matches in `re` for text): written as a
# regex class body that Java regex and RE2 both read the same way.
PY_WS_BODY = (
    r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
PY_WS = "[" + PY_WS_BODY + "]"
WORD_CHAR = r"[\p{L}\p{M}\p{N}]"
# ASCII punctuation, stripped from token ends before the frequency lookup.
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
