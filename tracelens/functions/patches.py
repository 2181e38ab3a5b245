"""Line changes of unified patches.

A patch is hunks: a header ``@@ -start[,count] +start[,count] @@`` and lines
that begin with ``-`` (removed), ``+`` (added) or a space (kept; a bare empty
line is a kept one); a line that begins with a backslash remarks on the line
before it.  What precedes the first hunk (file headers) is not a line of the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the header of a hunk.
HUNK = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def hunks(patch: Column | str) -> Column:
    """The hunks of a patch in order, each the array of its lines, header first; NULL patch: none."""
    text = F.col(patch) if isinstance(patch, str) else patch
    blocks = F.filter(F.split(text, rf"(?md)^(?={HUNK})"), lambda b: F.regexp_like(b, F.lit(f"^{HUNK}")))
    whole = lambda b: F.when(F.endswith(b, F.lit("\n")), F.substr(b, F.lit(1), F.length(b) - 1)).otherwise(b)
    return F.coalesce(F.transform(blocks, lambda b: F.split(whole(b), "\n")),
                      F.array().cast("array<array<string>>"))


def _start(header: Column, side: int) -> Column:
    """First line number of a side (1 old, 2 new); a side without lines names the line before it."""
    start = F.regexp_extract(header, HUNK, 2 * side - 1).cast("int")
    return F.when(F.regexp_extract(header, HUNK, 2 * side) == "0", start + 1).otherwise(start)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hunk_lines(hunk: Column, number: Column) -> Column:
    """``array<struct<hunk, text, old_line, new_line>>`` of one hunk, each text with its mark.

    Lines of the file before are those without ``+``, lines of the file after
    those without ``-``; their numbers are their places among these, and the
    kept lines are the same in both.  Linear in the hunk, no window, no shuffle;
    the header is read once a hunk and the lines are divided once.
    """
    marked = lambda x, mark: F.startswith(x, F.lit(mark))

    def side(whole: Column, first: str, other: str) -> Column:
        return F.transform(F.filter(whole["body"], lambda x: ~marked(x, other)), lambda x, i: F.struct(x.alias("x"), (whole[first] + i).alias("n")))

    def row(text: Column, old: Column, new: Column) -> Column:
        return F.struct(number.alias("hunk"), text.alias("text"), old.cast("int").alias("old_line"), new.cast("int").alias("new_line"))

    def rows(sides: Column) -> Column:
        old, new, none = sides["old"], sides["new"], F.lit(None)
        return F.concat(
            F.transform(F.filter(old, lambda r: marked(r["x"], "-")), lambda r: row(r["x"], r["n"], none)),
            F.transform(F.filter(new, lambda r: marked(r["x"], "+")), lambda r: row(r["x"], none, r["n"])),
            F.zip_with(F.filter(old, lambda r: ~marked(r["x"], "-")), F.filter(new, lambda r: ~marked(r["x"], "+")),
                       lambda a, b: row(a["x"], a["n"], b["n"])))

    header = F.get(hunk, F.lit(0))
    body = F.filter(hunk, lambda x, i: (i > 0) & ~marked(x, "\\"))
    whole = F.struct(body.alias("body"), _start(header, 1).alias("first_old"), _start(header, 2).alias("first_new"))
    return _let(whole, lambda w: _let(F.struct(side(w, "first_old", "+").alias("old"), side(w, "first_new", "-").alias("new")), rows))


def patch_lines(changes: DataFrame, patch: str = "patch") -> DataFrame:
    """A row per line of every hunk: the other columns, ``hunk`` (from 1), ``kind``, ``old_line``, ``new_line``, ``line``.

    Line numbers count from 1 in the file before and after; they are NULL on
    the side that lacks the line.
    """
    others = [c for c in changes.columns if c != patch]
    lines = F.flatten(F.transform(hunks(patch), lambda h, i: _hunk_lines(h, i + 1)))
    # Outer, then without the empty row: an inner explode lets the planner add a filter that computes the lines a second time.
    each = changes.select(*others, F.explode_outer(lines).alias("__r")).where(F.col("__r").isNotNull())
    r = F.col("__r")
    kind = F.when(F.startswith(r["text"], F.lit("-")), "removed").when(F.startswith(r["text"], F.lit("+")), "added").otherwise("kept")
    return each.select(*others, r["hunk"].alias("hunk"), kind.alias("kind"), r["old_line"].alias("old_line"), r["new_line"].alias("new_line"),
                       F.substr(r["text"], F.lit(2)).alias("line"))


def patch_counts(patch: Column | str) -> tuple[Column, Column]:
    """Lines added and removed by a patch, to be held against the ``additions`` and ``deletions`` of its row."""
    lines = F.flatten(F.transform(hunks(patch), lambda h: F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))))
    return tuple(F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(m)))) for m in "+-")
