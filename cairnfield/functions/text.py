"""Text columns: cleaning, normalising, hashing. Built-in expressions alone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of consent banners and window chrome; a line that holds one is dropped.
CONSENT_PHRASES = (
    "essential site functionality",
    "accept all",
    "reject all",
    "manage preferences",
    "manage consent",
    "consent selection",
    "withdraw your consent",
    "your consent applies",
    "your prior consent",
    "strictly necessary",
    "learn more about this provider",
    "maximum storage duration",
    "skip to main content",
    "opens in a new window",
    "opens an external website",
    "close this dialog",
    "privacy policy manage",
    "preferences statistics marketing",
)

# Markdown noise. (?U): white space as Unicode has it; (?md): lines end at newline alone.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\([^)]*\)"
BARE_URL = r"(?U)https?://\S+"
DECORATION = r"(?Umd)^[\s>*\-#=_|`]+$"
#: All white space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use() names it."""
    return F.transform(F.array(value), use)[0]


def strip(col: Column) -> Column:
    """Trim all kinds of white space (trim() knows spaces alone)."""
    return F.btrim(col, F.lit(SPACE))


def drop_consent_lines(col: Column) -> Column:
    """Without the lines that mention cookies or hold a consent phrase; the bare word "consent" stays."""

    def is_noise(text: Column) -> Column:
        return let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in ("cookie", *CONSENT_PHRASES))))

    # phrases hold no newline: a text without any is left alone
    return let(col, lambda text: F.when(is_noise(text), F.array_join(F.filter(F.split(text, "\n"), lambda line: ~is_noise(line)), "\n")).otherwise(text))


def clean_markdown(col: Column) -> Column:
    """Images gone, links unwrapped, bare URLs gone, decoration-only lines emptied, consent lines gone."""
    for pattern, by in ((IMAGE, ""), (LINK, "$1"), (BARE_URL, ""), (DECORATION, "")):
        col = F.regexp_replace(col, pattern, by)
    return drop_consent_lines(col)


def normalize_text(col: Column) -> Column:
    """Clean markdown with one kind of newline, single spaces and at most one blank line in a row."""
    col = clean_markdown(F.regexp_replace(col, "\r\n?", "\n"))
    # single spaces match nothing, so most of a text is copied as it is
    col = F.regexp_replace(F.regexp_replace(col, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
    return strip(col)


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def chunk_id(url: Column, ordinal: Column) -> Column:
    """Stable by position: the hash of url#ordinal."""
    return F.sha2(F.concat_ws("#", url, ordinal.cast("string")), 256)


def truncate_normalize(vec: Column, dim: int) -> Column:
    """The first dim components, scaled to length 1 (a zero vector stays zero). Doubles."""
    head = F.transform(F.slice(vec, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(head, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def terms(col: Column) -> Column:
    """Lower-cased alphanumeric terms, in order, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
