"""Functions of Python sources (I1) and descriptive text."""

import pytest

from tracelens.operators import codeunits as cu

GOLDEN = '''
class A:
    def f(self):
        return 1
    async def g(self):
        return 2

def h():
    def k():
        pass
    return k
'''


def _src(spark, rows):
    return spark.createDataFrame(rows, "blob_sha string, source string")


def test_functions_golden_bfs_order():
    assert [q for q, *_ in cu._functions_of(GOLDEN)] == ["h", "A.f", "h.<locals>.k"]


def test_extract_functions_and_rejects(spark):
    df = _src(spark, [("a", GOLDEN), ("b", "def broken(:\n"), ("c", "x = 1\n")])
    got = sorted((r.blob_sha, r.name, r.lineno) for r in cu.extract_functions(df).collect())
    assert got == [("a", "f", 3), ("a", "h", 8), ("a", "k", 9)]
    errs = [r.blob_sha for r in cu.parse_errors(df).collect()]
    assert errs == ["b"]


def test_code_pieces_selection():
    src = '''import os
from pkg import thing
# Handle the userLogin flow
@decorator
class LoginView(Base):
    """Docstring here."""
    def handleRequest(self, requestData):
        msg = 'bad input'
        sep = ':'
        other = "double quoted"
        return len(requestData) + os.sep.count(msg)
'''
    pieces = cu.code_pieces(src)
    kinds = [(k, t) for k, t in pieces]
    assert ("comment", "# Handle the userLogin flow") in kinds
    assert ("doc", '"""Docstring here."""') in kinds
    assert ("string", "bad input") in kinds
    assert ("name", "handleRequest") in kinds and ("name", "requestData") in kinds
    names = [t for k, t in kinds if k == "name"]
    assert "thing" in names  # what an import from a module brings in is a name
    for dropped in ("pkg", "LoginView", "decorator", "self", "len", "double quoted"):
        assert dropped not in names
    assert names.count("os") == 1  # the use in the body; the import is dropped
    assert ("string", ":") not in kinds
    assert "count" in names and "sep" in names  # attributes after '.' are plain names


def test_code_text(spark):
    df = _src(spark, [("a", 'def getUserName(self):\n    """Return  the\tname."""\n    return 1\n')])
    assert cu.code_text(df).first().text == 'get User Name """Return the name."""'


def test_code_pieces_of_strings_and_imports():
    src = '''import os.path as osp
from pkg.mod import first, second as other
def parseValue(rawText, count):
    """Parse it."""
    # keep this comment
    label = f'total {count} of' + f"dropped {rawText}"
    note = \'\'\'three quotes\'\'\'
    return 'done'
'''
    kinds = cu.code_pieces(src)
    strings = [t.strip() for k, t in kinds if k == "string"]
    assert strings == ["total", "of", "three quotes", "done"]
    names = [t for k, t in kinds if k == "name"]
    assert names == ["first", "second", "other", "parseValue", "rawText", "count", "label", "count", "rawText", "note"]
    assert ("doc", '"""Parse it."""') in kinds and ("comment", "# keep this comment") in kinds


def test_rejects_of_deep_nesting_and_other_encodings(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    df = _src(spark, [("deep", deep), ("null", None), ("good", "def f():\n    pass\n")])
    assert {r.blob_sha for r in cu.parse_errors(df).collect()} == {"deep", "null"}
    assert [r.name for r in cu.extract_functions(df).collect()] == ["f"]
    assert {r.blob_sha for r in cu.code_text(df).where("text is not null").collect()} >= {"good"}


def test_workers_hold_bounded_results(spark):
    """Results are handed on by size, and batches hold few whole sources."""
    import pandas as pd

    src = "def f():\n    return '" + "x" * 300_000 + "'\n"
    frame = pd.DataFrame({"blob_sha": [str(i) for i in range(12)], "source": [src] * 12})
    for batches in (cu._parse_batches, cu._pieces_batches):
        out = list(batches(iter([frame])))
        assert len(out) == 3 and sorted(b for x in out for b in x["blob_sha"]) == sorted(frame["blob_sha"])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        cu.extract_functions(_src(spark, [("a", GOLDEN)]))
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
