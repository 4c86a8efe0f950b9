"""Column functions on text: whitespace as Python's str methods see it, words, labels, trims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: str.split() also splits at the four information separators
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(c, rf"(?U){_SPACE}+", -1), lambda w: w != "")


def word_weight(c: Column | str) -> Column:
    """K1: whitespace words, at least 1, as double."""
    return F.greatest(F.lit(1), F.size(words(c))).cast("double")


def section_label(text: Column | str, heading: Column) -> Column:
    """The first "Section n.n" of the text, else the heading."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(section\s+\d+(?:\.\d+)*)", 1), F.lit("")), heading)


def sentences(c: Column | str, respect_abbreviations: bool = False) -> Column:
    """Stripped non-empty sentences.

    A boundary is whitespace after one of .!? and at most one closing sign, which is lost,
    before a capital or digit with at most one opening sign.  Abbreviations end sentences
    too, unless they are asked to be respected.
    """
    guard = r"(?<!\b(?:Dr|Mr|Ms|No|vs|Mrs|Inc|etc|e\.g|i\.e|Fig|Sec)\.)" if respect_abbreviations else ""
    parts = F.split(c, rf"""(?U)(?<=[.!?]){guard}["')\]]?\s+(?=["'(\[]?[A-Z0-9])""", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def trimmed(c: Column | str, width: int = 100) -> Column:
    """Whitespace collapsed; beyond the width, cut with an ellipsis."""
    flat = F.array_join(words(c), " ")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substr(flat, F.lit(1), F.lit(width - 1)), F.lit("…")))


def tokens(c: Column | str) -> Column:
    """Runs of letters or of numbers of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
