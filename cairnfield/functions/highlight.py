"""The passage of a text that best answers a query, with its terms marked. Built-in expressions alone, but for best_place()."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

WINDOW_CHARS, SLACK_CHARS = 360, 80

# Words that are no search terms.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "be", "by", "with", "as", "at", "from",
    "that", "this", "it", "its", "how", "what", "which", "do", "does", "we", "our", "their",
)

# A word of a query, the places where a sentence ends, and what stands for signs that HTML gives a meaning.
QUERY_WORD = r"[A-Za-z0-9][A-Za-z0-9\-']+"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def query_terms(query: Column) -> Column:
    """Distinct terms of three characters or more, in order."""
    words = F.regexp_extract_all(F.lower(query), F.lit(QUERY_WORD), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END, -1), strip), lambda p: p != "")


def term_hits(sentence: Column, terms: Column) -> Column:
    """How often the terms occur, as parts of words, too; lower-case terms."""
    return let(F.lower(sentence), lambda s: F.aggregate(terms, F.lit(0), lambda n, t: n + ((F.length(s) - F.length(F.replace(s, t))) / F.length(t)).cast("int")))


def best_sentence(parts, terms) -> int | None:
    """The place, from 0, of the sentence (lower case) with most hits of the terms, as term_hits() counts them; the first of equals."""
    if not len(parts):
        return None
    text = "\n".join(parts)  # a term holds no newline, so its places stay within sentences
    found: list[int] = []
    for term in terms:
        at = text.find(term)
        while at >= 0:
            found.append(at)
            at = text.find(term, at + len(term))
    begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    return int(np.bincount(np.searchsorted(begins, found, "right") - 1, minlength=len(parts)).argmax()) if found else 0


def best_place(query: Column, text: Column) -> Column:
    """What highlight() takes as `best`, where queries may be as long as texts: each term is looked for once in a text, not once a sentence."""

    @F.pandas_udf("int")
    def best(parts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([best_sentence(p, t) for p, t in zip(parts, terms, strict=True)], dtype="Int32")

    return best(F.transform(sentences(F.coalesce(text, F.lit(""))), F.lower), query_terms(F.coalesce(query, F.lit(""))))


def grown(parts: Column, best: Column, size: int) -> Column:
    """(lo, hi), from 0: parts[best] with neighbours, right and left by turns, each while the whole is shorter than size.

    A neighbour adds its length and a space, so no more than size / 2 of them can join.
    """

    def step(now: Column, turn: Column) -> Column:
        right = (now["hi"] < F.size(parts) - 1) & ((turn % 2 == 1) | (now["lo"] == 0))
        lo, hi = F.when(right, now["lo"]).otherwise(now["lo"] - 1), F.when(right, now["hi"] + 1).otherwise(now["hi"])
        joins = (now["size"] < size) & (right | (now["lo"] > 0))
        moved = F.struct(lo.alias("lo"), hi.alias("hi"), (now["size"] + 1 + F.length(F.get(parts, F.when(right, hi).otherwise(lo)))).alias("size"))
        return F.when(joins, moved).otherwise(now)

    first = F.struct(best.alias("lo"), best.alias("hi"), F.length(F.get(parts, best)).alias("size"))
    turns = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(size // 2 + 1)))
    return F.aggregate(turns, first, step)


def cut(text: Column, most: int) -> Column:
    """text, or its first whole words of at most `most` characters and an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", ""), F.lit("…")))


def escaped(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def marked(safe: Column, terms: Column) -> Column:
    """Terms in <mark>, on word boundaries and in any case. Terms hold letters, digits, - and ' alone, so they are patterns as they are."""
    pattern = F.concat(F.lit(r"(?Ui)\b("), F.array_join(terms, "|"), F.lit(r")\b"))
    return F.when(F.size(terms) > 0, F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>"))).otherwise(safe)


def highlight(query: Column, text: Column, size: int = WINDOW_CHARS, best: Column | None = None) -> Column:
    """The sentence with most term hits (the first of equals), grown to about size characters, escaped, terms in <mark>.

    Null queries and texts count as empty. A text without sentences gives its first characters. best: a column with best_place() of
    the two; without it the hits are counted sentence by sentence.
    """

    def passage(parts: Column, terms: Column, whole: Column) -> Column:
        hits = F.transform(parts, lambda p: term_hits(p, terms))
        place = let(hits, lambda h: F.array_position(h, F.array_max(h)).cast("int") - 1) if best is None else best
        found = let(grown(parts, place, size), lambda w: F.array_join(F.slice(parts, w["lo"] + 1, w["hi"] - w["lo"] + 1), " "))
        chosen = F.when(F.size(parts) > 0, cut(found, size + SLACK_CHARS)).otherwise(F.substring(whole, 1, size))
        return marked(escaped(chosen), terms)

    terms = query_terms(F.coalesce(query, F.lit("")))
    return let(F.coalesce(text, F.lit("")), lambda whole: let(sentences(whole), lambda parts: let(terms, lambda t: passage(parts, t, whole))))
