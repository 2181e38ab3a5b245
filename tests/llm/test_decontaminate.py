import random
import re

from tracelens.llm import decontaminate as d

from . import helpers

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(text, items, window):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[j:j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for trial in range(150):
        letters = "abc"[:rng.randint(2, 3)]
        say = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(k, say(rng.randint(0, 9))) for k in range(rng.randint(0, 5))]
        automaton = d.SuffixAutomaton([(str(k), d.words_of(t)) for k, t in items if d.words_of(t)], 4)
        text = say(rng.randint(0, 40))
        spans, found = automaton.match(d.words_of(text))
        assert (len(split(text)), sum(b - a for a, b in spans), sorted(found)) == brute(text, items, 4), (items, text)


def test_words_follow_the_definition():
    text = "Ab-C_d É9 x\x7fy \x00z ß'ÄÖ 中文"
    assert [w.decode() for w in d.words_of(text)] == split(text)


def test_report_on_odd_rows_and_blocks(spark):
    passage = helpers.words(30, 77)
    items = [(1, passage), (2, "tiny item"), (3, None), (4, "--- !"), (5, helpers.words(25, 78)), (5, helpers.words(25, 78))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = helpers.odd_rows() + [(30, "start " + passage.upper() + " end"), (31, "a Tiny, ITEM!"), (32, helpers.words(25, 78))]
    expected = sorted((str(i), *brute(t, items, 10)) for i, t, *_ in rows if i != 6)
    for size in (d.WORDS_PER_AUTOMATON, 20):
        got = d.report(helpers.docs(spark, rows), bench, words_per_automaton=size).collect()
        assert len(got) == len(rows)
        import hashlib
        digest = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in got if r.doc_id != 6) == [
            (i, n, h, digest(f)) for i, n, h, f in expected]
        assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_cut_removes_passages_only(spark):
    passage = helpers.words(30, 77)
    before, after = helpers.words(60, 5), helpers.words(60, 6)
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    table = helpers.docs(spark, [(1, f"{before} {passage}. {after}"), (2, passage), (3, before), (4, None), (5, "")])
    out = d.decontaminate(table, bench, chars_col="n_chars")
    assert out.columns == table.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5} and got[3].text == before and got[4].text is None
    assert split(got[1].text) == split(before + " " + after) and got[1].n_chars == len(got[1].text)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    table = helpers.docs(spark, [(1, "a b c")])
    assert [r.n_hit for r in d.report(table, bench).collect()] == [0]
    assert d.decontaminate(table, bench).count() == 1
    assert d.report(helpers.docs(spark, []), bench).count() == 0


def test_blocks_of_items_cut_as_one_automaton(spark):
    w = [f"q{k}" for k in range(200)]
    say = lambda *parts: " ".join(" ".join(p) for p in parts)
    items = [(1, say(w[0:18])), (2, say(w[100:116])), (3, say(w[8:24])), (4, say(w[30:36], w[60:66])), (5, "short one"), (6, "--- !")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, say(w[0:18], ["x", "y"], w[100:116], ["z"] * 5)),  # 34 of 41 words in two items
            (2, say(["a"] * 40, w[0:24], ["b"] * 20)),  # windows of items 1 and 3 overlap
            (3, say(["c"] * 50, w[30:36], w[100:116], w[60:66], ["d"] * 30)),  # cutting item 2 brings item 4 together
            (4, "nothing here"), (5, None), (6, ""), (7, say(["e"] * 30, ["SHORT"], ["one"], ["f"] * 3)), (8, say(w[0:18])), (8, "again")]
    rows += helpers.odd_rows()
    table = helpers.docs(spark, rows)
    key = lambda r: tuple(str(x) for x in r)
    one = d.decontaminate(table, bench, chars_col="n_chars")
    assert 1 not in {r.doc_id for r in one.where("text like 'q%'").collect()}
    for size in (20, 40):
        many = d.decontaminate(table, bench, chars_col="n_chars", words_per_automaton=size)
        assert many.schema.simpleString() == one.schema.simpleString()
        assert sorted(map(key, many.collect())) == sorted(map(key, one.collect()))
    assert d.decontaminate(table.limit(0), bench, words_per_automaton=20).count() == 0
