"""Functions of a question: synonym expansion and explicit references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ARTICLE, RECITAL, SYNONYMS
from .text import normalize


def expand(question: Column) -> Column:
    """The normalised question and, in the rules' order, every rule's expansion that it triggers. Expansions trigger nothing."""
    base = normalize(question)
    return F.concat_ws(" ", base, *(F.when(base.rlike(r"\b(?:" + "|".join(words) + r")\b"), more) for words, more in SYNONYMS))


def reference(question: Column) -> Column:
    """struct<tipo, n, par> of an explicit reference, else null. An article is looked for first; par is null if none is given."""
    base = normalize(question)
    number = lambda pattern, group: F.nullif(F.regexp_extract(base, pattern, group), F.lit("")).cast("int")
    make = lambda kind, n, par: F.struct(F.lit(kind).alias("tipo"), n.alias("n"), par.alias("par"))
    return F.when(base.rlike(ARTICLE), make("articolo", number(ARTICLE, 1), number(ARTICLE, 2))).when(base.rlike(RECITAL), make("considerando", number(RECITAL, 1), F.lit(None).cast("int")))
