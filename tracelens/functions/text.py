"""Text expressions (JVM-side, codegen friendly).

All functions build ``Column`` expressions; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These patterns define results that must match the reference's
# behaviour (default TF-IDF tokeniser, identifier splitting, acronym search).
# ---------------------------------------------------------------------------
# Words of two or more word characters, after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Runs of whitespace (Unicode aware in Java with the (?U) flag).
WHITESPACE_PATTERN = r"(?U)\s+"
# Acronym candidates: whole words made of ASCII capitals only.
ACRONYM_PATTERN = r"\b[A-Z]+\b"
# Capital letters (any script) that start a new word inside an identifier.
UPPER_PATTERN = r"(\p{Lu})"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col: Column | str) -> Column:
    """``array<string>`` of lower-cased words of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def token_count(col: Column | str) -> Column:
    """Number of H14 tokens, counted without building the token array."""
    return F.regexp_count(F.lower(_c(col)), F.lit(TOKEN_PATTERN))


def collapse_whitespace(col: Column | str) -> Column:
    """``" ".join(s.split())``."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE_PATTERN, " "))


def split_identifier(col: Column | str, keep_capital_runs: bool = False) -> Column:
    """H9: put ``_`` before each capital, split on ``_``, drop empty parts, join by spaces.

    Case is kept; with the default a run of capitals falls apart into single
    letters (``HTTPServer`` -> ``H T T P Server``).  ``keep_capital_runs``
    keeps such runs together (``HTTP Server``), an option the build adds.
    """
    c = _c(col)
    if keep_capital_runs:
        c = F.regexp_replace(c, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1_$2")
        c = F.regexp_replace(c, r"(\p{Ll}|\p{N})(\p{Lu})", "$1_$2")
    else:
        c = F.regexp_replace(c, UPPER_PATTERN, "_$1")
    return F.array_join(F.filter(F.split(c, "_"), lambda s: s != ""), " ")


def find_acronyms(col: Column | str) -> Column:
    """All ``\\b[A-Z]+\\b`` words, in text order."""
    return F.regexp_extract_all(_c(col), F.lit(ACRONYM_PATTERN), 0)


def is_all_caps(col: Column | str) -> Column:
    """``str.isupper()`` - has a cased letter and none in lower case."""
    c = _c(col)
    return (c == F.upper(c)) & (c != F.lower(c))


def lines(col: Column | str) -> Column:
    """Lines of a text, each stripped of surrounding whitespace; empty lines dropped."""
    parts = F.split(F.regexp_replace(_c(col), r"\r\n", "\n"), "\n")
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")


def issue_text(title: Column | str, body: Column | str) -> Column:
    """H6: query text of an issue, ``title + ', ' + body``; NULL parts skipped."""
    return F.concat_ws(", ", _c(title), _c(body))


def join_topics(col: Column | str) -> Column:
    """H5: ``', '.join(topics)``."""
    return F.array_join(_c(col), ", ")
