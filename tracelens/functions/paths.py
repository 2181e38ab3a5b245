"""Path and name expressions (H4, H7, H8)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: name of the first function defined in a source text.
FUNCTION_NAME_PATTERN = r"def\s+(\w+)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def short_repo_name(full_name: Column | str) -> Column:
    """H4: ``owner/repo`` -> ``repo``."""
    return F.substring_index(_c(full_name), "/", -1)


def relative_path(path: Column | str, root: str) -> Column:
    """H7: path below ``root`` with ``/`` separators; both separators accepted.

    ``root`` is escaped, so a repository name with regex characters is safe.
    Paths outside ``root`` give an empty string.
    """
    pattern = "^" + re.escape(root) + r"[\\/](.+)$"
    return F.translate(F.regexp_extract(_c(path), pattern, 1), "\\", "/")


def function_name(source: Column | str) -> Column:
    """H8: name after the first ``def``; empty string when absent."""
    return F.regexp_extract(_c(source), FUNCTION_NAME_PATTERN, 1)
