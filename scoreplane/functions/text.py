"""Text scalars as native Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() whitespace set, spelled for Java and RE2 alike.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as literal characters, for btrim (which only looks at the ends).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Trim every kind of whitespace at both ends (Spark ``trim`` strips spaces only)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def normalize(c) -> Column:
    """H1: lower case + strip."""
    return F.lower(strip_ws(c))


def quote_regex(s: str) -> str:
    """Literal quoting understood by Java regex and RE2."""
    if "\\E" in s:
        return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
    return "\\Q" + s + "\\E"


def phrase_pattern(phrase: str) -> str:
    """H3: phrase whose neighbours are not a-z (digits and punctuation are boundaries)."""
    return "(?<![a-z])" + quote_regex(phrase) + "(?![a-z])"


def phrase_pattern_portable(phrase: str) -> str:
    """H3 without look-behind (same booleans for an existence test)."""
    return "(^|[^a-z])" + quote_regex(phrase) + "([^a-z]|$)"


def has_phrase(c, phrase: str) -> Column:
    """H3 for one literal phrase: cheap ``contains`` first, then the bounded regex."""
    c = _c(c)
    return c.contains(phrase) & c.rlike(phrase_pattern(phrase))


def has_any_phrase(c, phrases) -> Column:
    """Any-of over a term list."""
    return functools.reduce(lambda a, b: a | b, [has_phrase(c, p) for p in phrases], F.lit(False))


def word_count(c) -> Column:
    """H4: whitespace-separated word count (empty text has 0 words)."""
    return F.size(F.filter(F.split(_c(c), f"{WS}+"), lambda w: w != "")).cast("bigint")


def fewer_words_than(c, n: int) -> Column:
    """H4 as a predicate that stops reading after ``n`` words (long texts stay cheap)."""
    if n <= 0:
        return F.lit(False)
    pat = f"^{WS}*+(?:[^{WS[1:-1]}]++{WS}++){{{n - 1}}}[^{WS[1:-1]}]"
    return ~_c(c).rlike(pat)


def compose_text(description, resume) -> Column:
    """H5: description, blank line, résumé; stripped; only when résumé is non-empty."""
    d, r = _c(description), _c(resume)
    return F.when(F.coalesce(r, F.lit("")) != "",
                  strip_ws(F.concat(F.coalesce(d, F.lit("")), F.lit("\n\n"), r))).otherwise(d)


def split_list(c, sep: str = ",") -> Column:
    """Separated list -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(_c(c), sep), lambda x: strip_ws(x)), lambda x: x != "")
