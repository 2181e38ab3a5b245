"""Code-unit queries over Python modules derived from ``documents``.

Each document becomes one module: line i of the document (stripped, empty
lines dropped) gives a four-line block whose docstring is the line with
quotes, backslashes and control characters removed.  Blocks cycle through a
top-level ``def``, an ``async def`` and a ``class`` holding one method; the
function name is the line's first ASCII word (``f`` when none) plus ``_i``.
Block i starts at source line 4i + 1, so the expected functions and the
expected descriptive text are computable in SQL as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths as fp
from ..functions import text as ft
from ..operators import codeunits as cu
from .registry import register
from .tables import table

CLEAN_RE = r'[\x00-\x1f"\\]'


def _name(line: Column, i: Column) -> Column:
    word = F.regexp_extract(F.lower(line), "[a-z]+", 0)
    return F.concat(F.when(word == "", F.lit("f")).otherwise(word), F.lit("_"), i.cast("string"))


def _block(line: Column, i: Column) -> Column:
    doc = F.regexp_replace(line, CLEAN_RE, "")
    name, num = _name(line, i), i.cast("string")
    top = F.concat(F.lit("def "), name, F.lit('():\n    """'), doc, F.lit('"""\n    return '), num,
                   F.lit("\n\n"))
    asyn = F.concat(F.lit("async "), top)
    klass = F.concat(F.lit("class K"), num, F.lit(":\n    def "), name, F.lit('(self):\n        """'),
                     doc, F.lit('"""\n        return '), num, F.lit("\n"))
    return F.when(i % 3 == 0, top).when(i % 3 == 1, asyn).otherwise(klass)


def module_ids(spark, sf_dir):
    """``(doc_id, blob_sha)``: the content id of each document's module.

    A module is a deterministic function of its document's text, so the hash
    of the text identifies it; mapping files to parsed content needs no
    module text.
    """
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha1("text").alias("blob_sha"))


def modules(spark, sf_dir):
    """``(doc_id, blob_sha, source)``: one generated module per document."""
    d = table(spark, sf_dir, "documents")
    src = F.array_join(F.transform(ft.lines("text"), lambda l, i: _block(l, i)), "")
    return d.select("doc_id", F.sha1("text").alias("blob_sha"), src.alias("source"))


_DUCK_LINES = (r"list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), "
               r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')")
_DUCK_NAME = "coalesce(nullif(regexp_extract(lower(l), '[a-z]+', 0), ''), 'f') || '_' || CAST(i AS VARCHAR)"
_DUCK_DOC = "regexp_replace(l, '" + CLEAN_RE + "', '', 'g')"


@register("func_names", sql=f"""
WITH ln AS (SELECT doc_id, unnest(L) AS l, unnest(generate_series(0, len(L) - 1)) AS i
            FROM (SELECT doc_id, {_DUCK_LINES} AS L FROM documents)),
f AS (SELECT doc_id, i, {_DUCK_NAME} AS name FROM ln WHERE i % 3 <> 1)
SELECT doc_id,
       CASE WHEN i % 3 = 0 THEN name ELSE 'K' || CAST(i AS VARCHAR) || '.' || name END AS qualname,
       name,
       CAST(CASE WHEN i % 3 = 0 THEN 4 * i + 1 ELSE 4 * i + 2 END AS INTEGER) AS lineno,
       name AS src_name
FROM f
""")
def func_names(spark, sf_dir):
    """I1 + H8: functions of every module; the name read back from the re-printed source."""
    funcs = cu.extract_functions(modules(spark, sf_dir))
    return (module_ids(spark, sf_dir).join(funcs, "blob_sha")
                .select("doc_id", "qualname", "name", "lineno",
                        fp.function_name("source").alias("src_name")))


_TQ = '"' * 3
_DUCK_TEXT_NAME = _DUCK_NAME.replace("CAST(i AS", "CAST(j - 1 AS")
FILE_TEXT_SQL = (
    "SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(" + _DUCK_LINES + ", "
    "lambda l, j: replace(" + _DUCK_TEXT_NAME + ", '_', ' ') || ' " + _TQ + "' || " + _DUCK_DOC
    + " || '" + _TQ + "'), ' '), '\\s+', ' ', 'g')) AS text FROM documents")


@register("file_text", sql=FILE_TEXT_SQL)
def file_text(spark, sf_dir):
    """I2 + B13 + H9 + H10: descriptive text of every module (names split, docstrings kept)."""
    texts = cu.code_text(modules(spark, sf_dir))
    return module_ids(spark, sf_dir).join(texts, "blob_sha").select("doc_id", "text")
