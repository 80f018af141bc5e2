"""Limits and fixed values of the passage model."""

MAX_CANDIDATES = 1_000
MAX_CONTEXT_CHARS = 48_000
MAX_PASSAGE_CHARS = 24_000
MAX_REQUESTS = 16
MAX_PASSAGES_PER_REQUEST = 50
MAX_CACHED_SCORES = 1_000_000
PAGE_ROWS = 25
SEMANTIC_FLOOR = 0.15
K1, B = 1.2, 0.25
LEXICAL_WEIGHT, SEMANTIC_WEIGHT, RANK_OFFSET = 0.65, 0.35, 60

# The stop words that search leaves out.
STOP_WORDS = tuple(
    "the a an and or to of in on for is are was were what how why with from this that does do define defines can could would should been be being my your our their at it its".split()
)
CONTRIBUTIONS = ("definition", "condition", "distinction", "other")

#: The white space of passages: that of ECMAScript, in Java's and in RE2's notation.
SPACE_CLASS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters, one by one.
SPACES = "\t\n\x0B\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_CLASS_RE2 = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: An opening fence of a saved question, in parts: the fence, its language, the rest.
FENCE_LANGUAGES = ("passage-question", "pq")
FENCE_PARTS = r"(?m)^( {0,3}(?:`{3,}|~{3,}))(?:" + "|".join(FENCE_LANGUAGES) + r")([ \t\r]*)$"
