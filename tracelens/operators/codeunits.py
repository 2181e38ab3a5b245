"""Code units of Python source files.

Parsing source code is the one place where Python runs per file: Spark
partitions the distinct files (by content id) and a pandas batch function
parses each file with the standard library.  Everything after parsing
(identifier splitting, whitespace, joins) is back in Spark expressions.

* ``extract_functions`` (I1): every ``def`` found by a breadth-first walk of the
  syntax tree (methods and nested functions included, ``async def`` excluded),
  with qualified name, line and the function re-printed from the tree.
  Unparsable files yield no functions; ``parse_errors`` lists them.
* ``code_text`` (I2 + B13): the descriptive text of a file: comments,
  docstrings, the contents of single-quoted strings and plain or function
  names (split into words), in source order.
"""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import tokenize
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, split_identifier
from ..session import bound_batches

FUNCTION_SCHEMA = ("blob_sha string, qualname string, name string, lineno int, "
                   "end_lineno int, source string, error string")
# Characters of sources whose results a worker holds before it hands them on.
OUT_CHARS = 1 << 20
PIECES_SCHEMA = "blob_sha string, pieces array<struct<kind:string,text:string>>, error string"


def _functions_of(src: str) -> list[tuple]:
    """Breadth-first (``ast.walk`` order) list of FunctionDef nodes with qualnames."""
    tree = ast.parse(src)
    out = []
    todo = deque([(tree, "")])
    while todo:
        node, prefix = todo.popleft()
        if isinstance(node, ast.FunctionDef):
            q = prefix + node.name
            out.append((q, node.name, node.lineno, node.end_lineno, ast.unparse(node)))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            child_prefix = prefix + node.name + ".<locals>."
        elif isinstance(node, ast.ClassDef):
            child_prefix = prefix + node.name + "."
        else:
            child_prefix = prefix
        todo.extend((c, child_prefix) for c in ast.iter_child_nodes(node))
    return out


FUNCTION_COLUMNS = ["blob_sha", "qualname", "name", "lineno", "end_lineno", "source", "error"]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, held = [], 0
        for blob, src in zip(pdf["blob_sha"], pdf["source"]):
            # What a worker holds is bounded by characters, whatever the batch.
            if held > OUT_CHARS:
                yield pd.DataFrame(rows, columns=FUNCTION_COLUMNS)
                rows, held = [], 0
            held += len(src or "")
            try:
                if src is None:
                    raise ValueError("not UTF-8 text")
                for q, name, line, end, text in _functions_of(src):
                    rows.append((blob, q, name, line, end, text, None))
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append((blob, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=FUNCTION_COLUMNS)


def parse_sources(sources: DataFrame, blob: str = "blob_sha", source: str = "source") -> DataFrame:
    """Parse each distinct file once; rows for functions and for parse errors.

    Distinct files are hash-partitioned by content id, which spreads the
    Python work over all tasks whatever the input file layout.
    """
    bound_batches(sources.sparkSession)
    files = (sources.select(F.col(blob).alias("blob_sha"), F.col(source).alias("source"))
                    .dropDuplicates(["blob_sha"]))
    return files.mapInPandas(_parse_batches, FUNCTION_SCHEMA)


def extract_functions(sources: DataFrame, blob: str = "blob_sha", source: str = "source") -> DataFrame:
    """``(blob_sha, qualname, name, lineno, end_lineno, source)`` per function."""
    return parse_sources(sources, blob, source).where(F.col("error").isNull()).drop("error")


def parse_errors(sources: DataFrame, blob: str = "blob_sha", source: str = "source") -> DataFrame:
    """Files that do not parse (the reference aborted the whole run on one)."""
    return (parse_sources(sources, blob, source).where(F.col("error").isNotNull())
            .select("blob_sha", "error"))


# ---------------------------------------------------------------------------
# Descriptive text of a file
# ---------------------------------------------------------------------------

_BUILTINS = frozenset(dir(builtins)) | {"self", "cls"}
_SKIP_AFTER = {"class", "from", "@"}
# Tokens of formatted strings (absent before Python 3.12, where they are whole STRING tokens).
_F_START = getattr(tokenize, "FSTRING_START", None)
_F_MIDDLE = getattr(tokenize, "FSTRING_MIDDLE", None)
_F_END = getattr(tokenize, "FSTRING_END", None)


def _is_docstring_start(prev_type: int) -> bool:
    return prev_type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT,
                         tokenize.ENCODING, None)


def code_pieces(src: str) -> list[tuple[str, str]]:
    """B13 selection over the standard tokenizer, as ``(kind, text)`` pairs.

    Kept: comments; triple-quoted strings that start a logical line
    (docstrings), whole token; the contents of other strings in single quotes,
    one or three, formatted ones piece by piece, unless they are ``:`` or
    ``;``; function names after ``def`` unless dunder; plain names
    (``kind = "name"``, to be split into words), also those that ``from x
    import`` brings in.  Dropped: keywords, builtins and ``self``/``cls``,
    class names, decorator names, module names, strings in double quotes,
    numbers, operators.
    """
    out: list[tuple[str, str]] = []
    prev_type, prev_str = None, None
    module = None  # "import" or "from" while module names are read
    quotes: list[bool] = []  # open formatted strings: in single quotes?

    def add_string(text: str) -> None:
        if text not in ("", ":", ";"):
            out.append(("string", text))

    for tok in tokenize.generate_tokens(io.StringIO(src).readline):
        t, s = tok.type, tok.string
        if t == tokenize.NEWLINE:
            module = None
        if t == _F_START and t is not None:
            quotes.append(s.lstrip("rRbBuUfF")[:1] == "'")
        elif t == _F_END and t is not None:
            quotes.pop()
        elif t == _F_MIDDLE and t is not None:
            if quotes and quotes[-1]:
                add_string(s)
        elif t == tokenize.COMMENT:
            out.append(("comment", s))
        elif t == tokenize.STRING:
            body = s.lstrip("rRbBuUfF")
            if body[:3] in ('"""', "'''") and _is_docstring_start(prev_type):
                out.append(("doc", s))
            elif body[:3] == "'''":
                add_string(body[3:-3])
            elif body[:1] == "'":
                add_string(body[1:-1])
        elif t == tokenize.NAME:
            if s == "import":
                module = None if module == "from" else "import"
            elif s == "from" and _is_docstring_start(prev_type):
                module = "from"
            if keyword.iskeyword(s):
                pass
            elif prev_str == "def":
                if not (s.startswith("__") and s.endswith("__")):
                    out.append(("name", s))
            elif prev_str in _SKIP_AFTER or module:
                pass
            elif prev_str == "." or s not in _BUILTINS:
                if not (s.startswith("__") and s.endswith("__")):
                    out.append(("name", s))
        if t not in (tokenize.NL, tokenize.COMMENT):
            prev_type, prev_str = t, s
    return out


def _pieces_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        blobs, pieces, errors, held = [], [], [], 0
        for blob, src in zip(pdf["blob_sha"], pdf["source"]):
            if held > OUT_CHARS:
                yield pd.DataFrame({"blob_sha": blobs, "pieces": pieces, "error": errors})
                blobs, pieces, errors, held = [], [], [], 0
            held += len(src or "")
            try:
                if src is None:
                    raise ValueError("not UTF-8 text")
                p = [{"kind": k, "text": x} for k, x in code_pieces(src)]
                err = None
            except (tokenize.TokenError, SyntaxError, ValueError, RecursionError, MemoryError) as e:
                p, err = None, f"{type(e).__name__}: {e}"
            blobs.append(blob)
            pieces.append(p)
            errors.append(err)
        yield pd.DataFrame({"blob_sha": blobs, "pieces": pieces, "error": errors})


def code_text(sources: DataFrame, blob: str = "blob_sha", source: str = "source") -> DataFrame:
    """``(blob_sha, text)`` - the descriptive text of each distinct file.

    Names are split by H9 and the result collapsed by H10 in Spark; files the
    tokenizer rejects get NULL text.
    """
    bound_batches(sources.sparkSession)
    files = (sources.select(F.col(blob).alias("blob_sha"), F.col(source).alias("source"))
                    .dropDuplicates(["blob_sha"]))
    raw = files.mapInPandas(_pieces_batches, PIECES_SCHEMA)
    words = F.transform("pieces", lambda p: F.when(p["kind"] == "name", split_identifier(p["text"]))
                                              .otherwise(p["text"]))
    return raw.select("blob_sha", collapse_whitespace(F.array_join(words, " ")).alias("text"))
