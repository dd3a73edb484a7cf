"""Text functions as column expressions: normalisers, keys, plausibility rules and flags.

Patterns carry (?U) where Unicode classes are meant, and (?d) where a dot must stop at newlines only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MARKUP, NATURAL, SCORABLE
from .markup import nfkc, rewrite_markup

#: White space as Python has it: Unicode's and the four separators below the space.
WS = r"[\s\x1c-\x1f]"
# Latin letters and the Cyrillic ones that look alike, and the characters of classes: dashes, quotes, horizontal spaces,
# punctuation, zero width, control characters, and what hints at mathematics.
LATIN, CYRILLIC = "aceiopxyABCEHKMOPTX", "асеіорхуАВСЕНКМОРТХ"
DASHES = "[\u2010-\u2015\u2212\ufe58\ufe63\uff0d]"
DOUBLE_QUOTES = '["\u201c\u201d\u201e\u00ab\u00bb\u2033]'
SINGLE_QUOTES = "['\u2018\u2019\u02bc\u2032]"
SPACES = "[ \\t\u00a0\u2000-\u200b\u3000]+"
PUNCTUATION = "[.,;:!?\"'`ʼ’‘“”„«»()\\[\\]{}]"
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
MATH_HINT = r"[0-9=+\-−–—×*/^√∫π%≈≤≥<>()\[\]{}]|[A-Za-z]{1,4}(?U:\d)"


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


# Struck-through text, with and without what replaces it.
STRUCK = ((r"(?d)~~.*?~~\{(.*?)\}", "$1"), (r"(?d)~~(.*?)~~", "$1"))


# What all region types share, in order.
COMMON = (
    (DASHES, "-"),
    (r"[_\-]{3,}", "___"),
    (DOUBLE_QUOTES, '"'),
    (SINGLE_QUOTES, "'"),
    (SPACES, " "),
    (rf"(?U)\({WS}+", "("),
    (rf"(?U){WS}+\)", ")"),
    (r" +\(", "("),
    (r" +([_^])", "$1"),
)


def _common(c: Column) -> Column:
    return chain(F.translate(c, LATIN, CYRILLIC), *COMMON)


def _table_lines(c: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(c, rf"(?U){WS}*\|{WS}*", "|"), "\n", -1), lambda x: strip(F.regexp_replace(x, r"^\|+|\|+$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: What any pattern of STRUCK, COMMON or ``strip`` needs: a text without it is left to the look-alike letters' translation alone.
TOUCHED = (
    "(?U)[~_\\-()^\t\u00a0\u2000-\u200b\u3000\u2010-\u2015\u2212\ufe58\ufe63\uff0d\"\u201c\u201d\u201e\u00ab\u00bb\u2033'\u2018\u2019\u02bc\u2032]"
    rf"|  |^{WS}|{WS}$"
)


#: Most texts are of these characters alone, which none of those patterns needs but for the space. They are listed one by one: a class of single
#: characters is a table, one of ranges or of Unicode's classes is asked range by range.
_UNTOUCHED = "".join(c if c.isalnum() else "\\" + c for c in map(chr, range(0x20, 0x7F)) if c not in "~_-()^\"'")


def touched(text: Column) -> Column:
    """Whether any pattern may change more than look-alike letters."""
    plain = text.rlike(rf"\A[{_UNTOUCHED}]*\z") & ~text.contains("  ") & ~text.startswith(" ") & ~text.endswith(" ")
    return ~plain & text.rlike(TOUCHED)


def normalize_natural(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(touched(text), strip(_common(chain(text, *STRUCK)))).otherwise(F.translate(text, LATIN, CYRILLIC))


def finish_markup(c: Column, kind: Column) -> Column:
    """What follows the markup rewriting of a formula or table."""
    common = _common(c)
    finished = strip(F.when(kind == "table", _table_lines(common)).otherwise(common))
    # of a table, cells and lines are rewritten too
    return F.when(touched(c) | ((kind == "table") & c.rlike(r"[|\n]")), finished).otherwise(F.translate(c, LATIN, CYRILLIC))


def normalize(text: Column, kind: Column) -> Column:
    """The metric's normaliser. Only formulas and tables pass through Python; other rows send a null there."""
    markup = kind.isin(*MARKUP)
    rewritten = rewrite_markup(F.when(markup, F.coalesce(text, F.lit(""))))
    return F.when(markup, finish_markup(rewritten, kind)).otherwise(normalize_natural(text))


def canonical_type(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin(*SCORABLE), low).otherwise(F.lit("handwritten"))


def normalize_target(text: Column, kind: Column) -> Column:
    """Training targets: formulas and tables keep their lines, all else becomes one line."""
    kind = canonical_type(kind)
    c = chain(nfkc(F.coalesce(text, F.lit(""))), *STRUCK, ("\r\n", "\n"), ("\r", "\n"))
    lines = F.transform(F.split(c, "\n", -1), lambda x: strip(F.regexp_replace(x, SPACES, " ")))
    cells = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?U){WS}*\|{WS}*", "|"), r"^\|+|\|+$", ""))
    kept = F.filter(F.when(kind == "table", cells).otherwise(lines), lambda x: x != "")
    return F.when(kind.isin(*MARKUP), F.array_join(kept, "\n")).otherwise(strip(F.regexp_replace(c, rf"(?U){WS}+", " ")))


def sanitize(text: Column) -> Column:
    c = chain(nfkc(F.coalesce(text, F.lit(""))), (ZERO_WIDTH, ""), (CONTROL, ""), ("\r\n", "\n"), ("\r", "\n"))
    return strip(c)


def plain_key(text: Column) -> Column:
    """Lower-cased NFKC text without punctuation, white space runs as one space."""
    c = chain(F.lower(nfkc(F.coalesce(text, F.lit("")))), (ZERO_WIDTH, ""), (rf"(?U){WS}+", " "), (PUNCTUATION, ""))
    return strip(c)


def compact(text: Column) -> Column:
    return F.regexp_replace(plain_key(text), r"(?U)[^\w]+", "")


def plain_key_v2(text: Column) -> Column:
    """The earlier key, as intended: lower case, white space runs as one space, no punctuation."""
    return strip(chain(F.lower(F.coalesce(text, F.lit(""))), (rf"(?U){WS}+", " "), (PUNCTUATION, "")))


def looks_math(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(MATH_HINT)


def token_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"(?U)^[^\w]+|[^\w]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def _count(text: Column, keep: str) -> Column:
    """Characters of ``text`` in a class."""
    return F.length(F.regexp_replace(text, rf"(?U)[^{keep}]", ""))


def _distinct_share(text: Column) -> Column:
    w = words(text)
    return F.size(F.array_distinct(w)) / F.size(w)


def is_confident(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    special = F.length(t) - _count(t, r"\p{L}\p{N} .,!?;:'\-—–()\[\]")
    return (_count(t, r"\p{L}\p{N}\u0400-\u04FF") > 0) & (
        (F.size(words(t)) < 4) | (_distinct_share(t) >= 0.4)
    ) & ((F.length(t) <= 5) | (special / F.length(t) <= 0.5))


def is_valid_label(text: Column, least: int = 2, most: int = 300) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    meaning = _count(t, r"\p{L}\p{Nd}\u0400-\u04FF")
    return F.length(t).between(least, most) & (meaning > 0) & (meaning / F.length(t) >= 0.3) & ((F.size(words(t)) <= 3) | (_distinct_share(t) >= 0.4))


def choose_text(primary: Column, other: Column, other_conf: Column) -> Column:
    """The primary text if it is confident; else the other if that has text, confidence above a half, and is confident."""
    take = ~is_confident(primary) & (strip(F.coalesce(other, F.lit(""))) != "") & (other_conf > 0.5) & is_confident(other)
    return F.when(F.coalesce(take, F.lit(False)), other).otherwise(primary)


# Flag patterns.
FLAGS = {
    "character_loop": r"(?s)(.)\1{11,}",
    "token_loop": r"(?iuU)\b(\w{2,})(?:\s+\1){4,}\b",
    "dash_loop": r"(?U)(?:\s*[—–_-]\s*){8,}",
}


def text_flags(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    found = [F.when(F.length(t) >= 180, F.lit("long_text")), *(F.when(t.rlike(p), F.lit(name)) for name, p in FLAGS.items())]
    return F.array_compact(F.array(*found))


def bin_label(value: Column, bins: tuple[tuple[int, int, str], ...]) -> Column:
    """Label of the first (least, most, label) that holds the value; the last label if none does."""
    out = F.lit(bins[-1][2])
    for least, most, label in reversed(bins):
        out = F.when(value.between(least, most), F.lit(label)).otherwise(out)
    return out


# Bins of text lengths and crop heights.
LENGTH_BINS = ((0, 15, "0-15"), (16, 40, "16-40"), (41, 96, "41-96"), (97, 180, "97-180"), (181, 10**9, "181+"))
HEIGHT_BINS = ((0, 32, "0-32"), (33, 64, "33-64"), (65, 128, "65-128"), (129, 256, "129-256"), (257, 10**9, "257+"))
# Token budgets by type.
TOKEN_BUDGETS = {"handwritten": 128, "printed": 160, "formula": 256, "table": 384, "annotation": 96}


def generation_settings(kind: Column, budgets: dict[str, int] | None = None, penalty: float = 1.05) -> Column:
    """Token budget and, for natural types only, the repetition penalty. ``budgets`` overrides single types."""
    table = TOKEN_BUDGETS | (budgets or {})
    kind = canonical_type(kind)
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)
    return F.struct(budget.alias("max_new_tokens"), F.when(kind.isin(*NATURAL) & F.lit(penalty != 1.0), F.lit(penalty)).alias("repetition_penalty"))
