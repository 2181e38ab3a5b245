"""Closing-reference extraction (H1, H2 scalar parts, H3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The closing keywords and reference forms that must match the
# reference's behaviour.
# Keywords: close closes closed fix fixes fixed resolve resolves resolved
# Forms:    <keyword><whitespace>#<n>
#           <keyword><whitespace>http(s)://<host>/<owner>/<repo>/<kind>/<n>
# The text is lower-cased first; there is no word boundary before the keyword.
# ---------------------------------------------------------------------------
CLOSING_KEYWORDS = (
    "close", "closes", "closed",
    "fix", "fixes", "fixed",
    "resolve", "resolves", "resolved",
)
# After "#" any decimal digits count, in an address ASCII digits only.
CLOSING_REF_PATTERN = (
    r"(?U)(?:" + "|".join(CLOSING_KEYWORDS) + r")\s+(?:#|https?://[^/]+/[^/]+/[^/]+/[^/]+/)((?<=#)\d+|[0-9]+)"
)
# First code points of the decimal digit rows that are read as numbers besides ASCII:
# Arabic-Indic, extended Arabic-Indic, Devanagari, Bengali, Thai, full width.
_DIGIT_ROWS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10)
_DIGITS = "".join(chr(row + d) for row in _DIGIT_ROWS for d in range(10))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def closing_refs(text: Column | str) -> Column:
    """H1: ``array<bigint>`` of referenced numbers in text order, duplicates kept.

    NULL text gives an empty array (a missing body has no links).
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))),
                                 F.lit(CLOSING_REF_PATTERN), 1)
    numbers = F.transform(found, lambda s: F.translate(s, _DIGITS, "0123456789" * len(_DIGIT_ROWS)).try_cast("bigint"))
    return F.filter(numbers, lambda n: n.isNotNull())


def first_ref(text: Column | str) -> Column:
    """First closing reference of a text, NULL when there is none."""
    return F.get(closing_refs(text), 0)


def number_from_url(url: Column | str) -> Column:
    """H3: trailing number of a URL (``.../pull/17`` -> 17); NULL when not a number."""
    return F.substring_index(_c(url), "/", -1).try_cast("bigint")
