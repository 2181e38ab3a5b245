"""Line changes of unified patches."""

import difflib
import random

from pyspark.sql import functions as F

from tracelens.functions.patches import patch_counts, patch_lines


def rows_of(spark, patch):
    df = spark.createDataFrame([(1, patch)], "id int, patch string")
    return [tuple(r)[1:] for r in patch_lines(df).orderBy("hunk", "old_line", "new_line").collect()]


def test_forms(spark):
    patch = ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,2 +3,3 @@ def f():\n keep\n-old\r\n+new\n+@@ -1 +1 @@\n"
             "\\ No newline at end of file\n@@ -0,0 +9 @@\n+made\n")
    got = set(rows_of(spark, patch))
    assert got == {(1, "kept", 3, 3, "keep"), (1, "removed", 4, None, "old\r"), (1, "added", None, 4, "new"),
                   (1, "added", None, 5, "@@ -1 +1 @@"), (2, "added", None, 9, "made")}
    assert set(rows_of(spark, "@@ -1,3 +1,2 @@\n a\n\n-b")) == {(1, "kept", 1, 1, "a"), (1, "kept", 2, 2, ""), (1, "removed", 3, None, "b")}
    assert set(rows_of(spark, "@@ -5 +4,0 @@\n-x @@ -1 +1 @@")) == {(1, "removed", 5, None, "x @@ -1 +1 @@")}
    for nothing in (None, "", "Binary files differ", "@@ -1 +1 @@"):
        assert rows_of(spark, nothing) == []


def test_random_files_can_be_rebuilt(spark):
    rng = random.Random(5)
    cases = []
    for i in range(40):
        old = [rng.choice("abcdef") * rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 8)):
            new.insert(rng.randint(0, len(new)), rng.choice(["+x", "-y", " z", "@@ -1 +1 @@", ""]))
        lines = list(difflib.unified_diff(old, new, lineterm="", n=rng.randint(0, 3)))
        adds = sum(x.startswith("+") for x in lines[2:])
        cases.append((i, old, new, "\n".join(lines), adds, sum(x.startswith("-") for x in lines[2:])))
    df = spark.createDataFrame([(c[0], c[3], c[4], c[5]) for c in cases], "id int, patch string, additions int, deletions int")
    found = patch_lines(df).collect()
    for i, old, new, *_ in cases:
        mine = [r for r in found if r.id == i]
        for r in mine:
            assert r.old_line is None or old[r.old_line - 1] == r.line
            assert r.new_line is None or new[r.new_line - 1] == r.line
        gone = {r.old_line for r in mine if r.kind == "removed"}
        made = {r.new_line for r in mine if r.kind == "added"}
        assert [x for n, x in enumerate(old, 1) if n not in gone] == [x for n, x in enumerate(new, 1) if n not in made]
    added, removed = patch_counts("patch")
    assert df.where((added != F.col("additions")) | (removed != F.col("deletions"))).count() == 0


def test_long_patch(spark):
    n = 60_000
    patch = f"@@ -1,{n} +1,{n} @@\n" + "\n".join(("-a", "+b")[i % 2] for i in range(2 * n))
    df = spark.createDataFrame([(1, patch)], "id int, patch string")
    got = patch_lines(df).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("old_line").alias("o"), F.max("new_line").alias("e")).collect()
    assert {tuple(r) for r in got} == {("removed", n, n, None), ("added", n, None, n)}


def test_lines_are_computed_once(spark):
    """The planner must not repeat the parsing in a filter before the explode."""
    df = spark.createDataFrame([(1, "@@ -1 +1 @@\n-a\n+b")], "id int, patch string").repartition(2)
    plan = patch_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=@@") == 1
