"""Goldens for the text expressions (FIXTURES 4: H9, H14; H10, H11, H12, H18, H4, H7, H8)."""

from pyspark.sql import functions as F

from tracelens.functions import paths as fp
from tracelens.functions import text as ft


def _one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr("v").alias("o")).first().o


def test_split_identifier_goldens(spark):
    cases = {
        "thisIsMyVariable": "this Is My Variable",
        "this_is_my_variable": "this is my variable",
        "HTTPServer": "H T T P Server",
        "__init__": "init",
        "ÉtéTwo": "Été Two",
    }
    for src, want in cases.items():
        assert _one(spark, ft.split_identifier, src) == want, src


def test_split_identifier_keep_capital_runs(spark):
    got = _one(spark, lambda c: ft.split_identifier(c, keep_capital_runs=True), "parseHTTPServerV2")
    assert got == "parse HTTP Server V2"


def test_tokenize_golden(spark):
    got = _one(spark, ft.tokenize, "The naïve x_y a I'm ½½ C3PO 你好")
    assert got == ["the", "naïve", "x_y", "½½", "c3po", "你好"]


def test_collapse_whitespace_and_lines(spark):
    assert _one(spark, ft.collapse_whitespace, "  a \t b\u00a0\n c  ") == "a b c"
    assert _one(spark, ft.lines, " x \r\n\n  y\t\n") == ["x", "y"]


def test_acronyms_and_caps(spark):
    assert _one(spark, ft.find_acronyms, "Use HTTP and the API, not Http or ÉTÉ") == ["HTTP", "API"]
    df = spark.createDataFrame([("ABC",), ("AbC",), ("123",), ("A1",)], "v string")
    assert [r.o for r in df.select(ft.is_all_caps("v").alias("o")).collect()] == [True, False, False, True]


def test_paths(spark):
    assert _one(spark, fp.short_repo_name, "nvbn/thefuck") == "thefuck"
    assert _one(spark, lambda c: fp.relative_path(c, "./test/repo"), "./test/repo\\a\\b.py") == "a/b.py"
    assert _one(spark, lambda c: fp.relative_path(c, "./test/repo"), "./test/repo/a/b.py") == "a/b.py"
    assert _one(spark, lambda c: fp.relative_path(c, "./test/re.po"), "./test/repoX/a") == ""
    assert _one(spark, fp.function_name, "async def  go_1(x):\n  def inner(): pass") == "go_1"


def test_issue_text_skips_null_body(spark):
    df = spark.createDataFrame([("T", "B"), ("T", None)], "t string, b string")
    assert [r.o for r in df.select(ft.issue_text("t", "b").alias("o")).collect()] == ["T, B", "T"]


def test_split_identifier_properties(spark):
    """No letter is lost, no word is empty, and capitals stand only at the start of a word."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from tracelens.functions.text import split_identifier

    chars = st.sampled_from(list("abcXYZ_09ÉéßΔδ") + ["__", "HTTP", "Server", "get", "Id"])
    idents = st.lists(st.lists(chars, max_size=10).map("".join), min_size=200, max_size=200)

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(idents)
    def check(batch):
        df = spark.createDataFrame(list(enumerate(batch)), "i int, s string")
        for r in df.select("s", split_identifier("s").alias("w")).collect():
            found = r.w.split(" ") if r.w else []
            assert "".join(found) == r.s.replace("_", ""), repr(r.s)
            assert all(found)
            assert not any(c.isupper() for word in found for c in word[1:])

    check()
    example = spark.createDataFrame([("getHTTPServer_id",)], "s string")
    assert example.select(split_identifier("s")).first()[0] == "get H T T P Server id"


def test_tokenize_matches_vectoriser_pattern(spark):
    """Property: H14 equals the default vectoriser tokens, (?u)\\b\\w\\w+\\b on lower-cased text."""
    import re

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    chars = st.sampled_from(list("aZ_9 .,-'\t\n") + ["é", "Ω", "ж", "中", "٣", "ß", " ", "x2", "__"])
    texts = st.lists(st.lists(chars, max_size=20).map("".join), min_size=200, max_size=200)
    pattern = re.compile(r"(?u)\b\w\w+\b")

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(texts)
    def check(batch):
        df = spark.createDataFrame(list(enumerate(batch)), "i int, t string")
        got = {r.i: list(r.toks) for r in df.select("i", ft.tokenize("t").alias("toks")).collect()}
        for i, t in enumerate(batch):
            assert got[i] == pattern.findall(t.lower()), repr(t)

    check()
