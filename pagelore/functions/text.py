"""String columns: white space, trimming and wiki/HTML markup removal.

Everything here is a ``Column -> Column`` expression on built-in functions, so
a whole cleaning pass stays one JVM-side projection over the pages table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (Unicode White_Space).
# SQL trim functions take them as a string; in a regex (?U) makes \s mean them.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Markup patterns and their replacements, in the order in which
# they have to run. (?s) lets the dot cross any line end, (?d) makes "\n" the
# only line end the dot stops at. The first entry is in every text that matches.
MARKUP_STEPS = (
    ("<gallery", r"(?s)(\|image.?=.?)?<gallery.*?>.*?</gallery>\\?\n?", ""),
    ("[[File:", r"(?s)\[\[File:.*?\]\]\\?", ""),
    ("__", r"(?s)__.*?__", ""),
    ("<!--", r"(?s)<!--.*?-->\\?\n?", ""),
    ("<", r"(?s)<span.*?>|</span>\\?\n?|<br.*?>\\?\n?", ""),
    ("<", r"(?s)<div.*?>|</div>\\?\n?", ""),
    ("'''", r"(?d)'{3,}(.*?)'{3,}", "$1"),
    ("[[", r"\[\[([^\[\]\|]+?)\|([^\[\]]+?)\]\]", "$2"),
    ("[[", r"(?d)\[\[(.*?)\]\]", "$1"),
)

# What a match of a step ends with, but for a backslash and a line end, where openers may lack it.
_CLOSERS = {
    pattern: closer
    for (_, pattern, _), closer in zip(
        MARKUP_STEPS, ("/gallery>", "]]", None, "-->", ">", ">", None, None, "]]"), strict=True
    )
    if closer
}
_MAX_LENGTH = (1 << 31) - 1
_WHITESPACE_RUN = r"(?U)\s+"


def trim(text: Column) -> Column:
    """Strip every kind of white space from both ends (linear, no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def trim_end(text: Column) -> Column:
    """Strip every kind of white space from the right end."""
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only strings; never null."""
    return text.isNull() | (trim(text) == "")


def collapse_whitespace(text: Column) -> Column:
    """Turn every run of white space into one space and trim the ends."""
    return F.btrim(F.regexp_replace(text, F.lit(_WHITESPACE_RUN), F.lit(" ")))


def clean_title(title: Column) -> Column:
    """Underscores to spaces, ends trimmed."""
    return trim(F.replace(title, F.lit("_"), F.lit(" ")))


def strip_markup(text: Column) -> Column:
    """Newlines to spaces, then every markup pattern in turn."""
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    for sign, pattern, replacement in MARKUP_STEPS:
        text = _replace_where(text, sign, pattern, replacement, _CLOSERS.get(pattern))
    return text


def _replace_where(text: Column, sign: str, pattern: str, replacement: str, closer: str | None) -> Column:
    """``regexp_replace`` for the texts that contain ``sign``: most hold little markup.

    Nothing behind the last ``closer`` can match, so the pattern is not tried there: an
    opener that is never closed would walk to the end of the text, and many of them take
    quadratic time. The lambda names the text, so that the steps before it are evaluated once.
    """

    def replaced(t: Column) -> Column:
        if closer is None:
            changed = F.regexp_replace(t, F.lit(pattern), F.lit(replacement))
            return F.when(F.contains(t, F.lit(sign)), changed).otherwise(t)
        rest = F.substring_index(t, closer, -1)
        # Two characters more: a backslash and a line end may belong to the match.
        closed = F.substring(t, F.lit(1), F.length(t) - F.length(rest) + 2)
        changed = F.concat(
            F.regexp_replace(closed, F.lit(pattern), F.lit(replacement)), F.substring(rest, 3, _MAX_LENGTH)
        )
        return F.when(F.contains(t, F.lit(sign)) & F.contains(t, F.lit(closer)), changed).otherwise(t)

    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def clean_content(text: Column) -> Column:
    """The full content chain: markup out, white space collapsed, trimmed."""
    return collapse_whitespace(strip_markup(text))
