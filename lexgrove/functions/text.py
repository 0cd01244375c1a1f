"""Scalar text functions, Column to Column; none leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import STOP_WORDS, SUFFIXES

#: The least character that composition may change, and all above it, of which the ranges that follow are taken.
MAY_CHANGE = r"[\x{300}-\x{10ffff}&&"
MARKS = "".join(map(chr, range(0x300, 0x370)))
#: The suffixes by their length, from the longest on; see suffix_length().
_ENDINGS = tuple((n, frozenset(x for x in SUFFIXES if len(x) == n)) for n in sorted({len(x) for x in SUFFIXES}, reverse=True))


@lru_cache
def folding() -> tuple[str, str]:
    """(from, to) for translate(): each lower-case letter that decomposes to one ASCII character and marks; then the marks, deleted."""
    source, target = [], []
    for code in range(0x80, 0x30000):
        ch = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", ch) if x not in MARKS)
        if ch.lower() == ch and len(plain) == 1 and plain.isascii() and plain != ch:
            source.append(ch)
            target.append(plain.lower())
    return "".join(source) + MARKS, "".join(target)


def folded(text: Column) -> Column:
    """Lower case without accents."""
    source, target = folding()
    lower = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(lower, source, target)).otherwise(lower)


def normalize(text: Column) -> Column:
    """Lower case without accents; apostrophes to spaces; each run of other characters outside a-z, 0-9, space to one space."""
    return F.regexp_replace(F.regexp_replace(folded(text), "['’`]", " "), "[^a-z0-9 ]+", " ")


def suffix_length(word: Column) -> Column:
    """Length of the suffix that a word loses: the first of the list that leaves four characters; 0 for none.

    Suffixes that end alike are in the list from the longest on, so the longest is the first, and a test of the word's last
    characters for each length stands for the list.
    """
    out = F.lit(0)
    for size in sorted({len(x) for x in SUFFIXES}):
        out = F.when((F.length(word) >= 4 + size) & F.substring(word, -size, size).isin(*(x for x in SUFFIXES if len(x) == size)), size).otherwise(out)
    return out


def _without(word: Column, left: Column) -> Column:
    """The first characters of a word, left of them or, if the last of these is a, e, i or o and four are left, one less."""
    vowel = (left >= 4) & F.substring(word, left, F.lit(1)).isin("a", "e", "i", "o")
    return F.substring(word, F.lit(1), left - F.when(vowel, 1).otherwise(0))


def stem(word: Column) -> Column:
    """The word without the first suffix that leaves four characters, then without a last a, e, i or o if four are left."""
    return _without(word, F.length(word) - suffix_length(word))


def stem_of(word: str) -> str:
    """stem() of one word, for tasks that count words in Arrow batches and stem each different one once."""
    left = next((len(word) - n for n, some in _ENDINGS if len(word) >= 4 + n and word[-n:] in some), len(word))
    return word[: left - (left >= 4 and word[left - 1] in "aeio")]


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside the functions of arrays Spark shares no common part."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stem_inside(word: Column) -> Column:
    """stem() for use inside functions of arrays."""
    return let(word, lambda w: let(F.length(w) - suffix_length(w), lambda left: _without(w, left)))


def raw_tokens(text: Column) -> Column:
    """Words of the normalised text, in order."""
    return F.filter(F.split(normalize(text), " +"), lambda w: w != "")


def kept_tokens(text: Column) -> Column:
    """Words of two characters or more that are no stop words; order and repetition stay."""
    return F.filter(F.split(normalize(text), " +"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def tokens(text: Column, stemmed: bool = True) -> Column:
    """The index terms of a text. Both sides of the search use this one function."""
    kept = kept_tokens(text)
    return F.transform(kept, stem_inside) if stemmed else kept


@lru_cache
def recomposing() -> str:
    """A regular expression for a character that composition (NFC) may change, alone or with what stands before it."""
    change = set()
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000 and not 0xAC00 <= code < 0xD7A4:
            ch = chr(code)
            parts = unicodedata.decomposition(ch)
            if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
                change.add(code)
            if parts and not parts.startswith("<"):
                change.update(int(x, 16) for x in parts.split()[1:])
    change.update((*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))  # vowels and finals of Hangul
    runs, codes = [], sorted(change)
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def composed(text: Column) -> Column:
    """The text in NFC. The JVM's functions have no such form, so a text that may change, and no other, goes through Python.

    The ranges of such characters are hundreds and are tried one by one; a character below all of them is told by one comparison.
    """

    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.coalesce(nfc(F.when(text.rlike(MAY_CHANGE + recomposing() + "]"), text)), text)


def tidy(text: Column) -> Column:
    """Typographic spaces and quotation marks made plain, white space runs to one space, ends trimmed; the text is in NFC already."""
    out = F.translate(text, "\u00a0\u2007\u202f’‘“”«»", "   ''\"\"\"\"")
    return F.trim(F.replace(F.regexp_replace(out, r"(?U)\s+", " "), F.lit('" :'), F.lit('":')))


def clean(text: Column) -> Column:
    """tidy() of the composed text (NFC)."""
    return tidy(composed(text))


def segments(text: Column, terms: Column) -> Column:
    """The text as array<struct<seg, hit>>: runs of letters and digits and what is between; hit if a run's stem is a term.

    The segments' concatenation is the text.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))

    def mark(seg: Column) -> Column:
        known = lambda root: (root != "") & F.array_contains(terms, root)
        hit = F.when(seg.rlike(r"^[\p{L}\p{N}]"), let(stem_inside(F.trim(normalize(seg))), known)).otherwise(False)
        return F.struct(seg.alias("seg"), hit.alias("hit"))

    return F.transform(runs, mark)
