"""Spelling variants: PartEnum against all pairs, whole operator against plain Python, odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tracelens.llm import spelling_variants as sv

SCHEMA = "word string, source string, doc_id bigint, text string"  # clashing names on purpose


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def _brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= 5}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), c, len(near[w]), words.get(form[w])) for w, c in words.items()}


def _texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    out = []
    for doc in range(60):
        words = []
        for _ in range(120):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcé") + w[i:], w[:i] + r.choice("abcé") + w[i + 1:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((doc, " ".join(words) + "."))
    return out


@pytest.mark.parametrize("parts", [sv.PARTS, {2: (2, 4), 1: (1, 3)}, {2: (1, 7), 1: (2, 3)}])
@pytest.mark.parametrize("refine", [2, 32])
def test_pairs_equal_all_pairs(spark, parts, refine):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(220)})
    table = spark.createDataFrame([(w, 7) for w in words], "word string, n bigint")
    got = [frozenset((x.a, x.b)) for x in sv.near_pairs(table, parts, refine).collect()]
    want = {frozenset((a, b)) for a in words for b in words if _near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_signatures_follow_the_parts():
    assert len(sv.signature_sets(2, 1, 6)) == 15
    assert len(sv.signature_sets(2, 2, 4)) == 8
    with pytest.raises(ValueError):
        sv.signature_sets(2, 1, 3)


def test_whole_operator_equals_plain_python(spark):
    docs = _texts(11) + [(99, "abcdefgx " * 6 + "abcdefgxy " * 40 + "abcdefgxyz " * 250)]
    table = spark.createDataFrame([("x", "y", d, t) for d, t in docs], SCHEMA)
    got = [tuple(r) for r in sv.group_variants(table).collect()]
    want = _brute(docs)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)  # forms, and chains of two


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)], "word string, form string")
    assert {r.root for r in sv.follow(forms).collect()} == {"w13"}


def test_odd_rows(spark):
    long = "abcdefg" * 50_000
    docs = [(None, "letter letter letter letter letter"), (1, None), (2, ""), (3, "12 34"), (4, long + " " + long), (4, long + " " + long),
            (5, "lettér " * 5), (6, long), (7, "short " * 9)]
    table = spark.createDataFrame([("x", "y", d, t) for d, t in docs], SCHEMA)
    assert {tuple(r) for r in sv.group_variants(table).collect()} == _brute(docs)
    assert sv.group_variants(table.limit(0)).count() == 0


def test_deletions_are_counted_where_the_checksum_falls(spark):
    docs = [(d, f"{w} " * 5) for d in range(300) for w in ("elephant", "giraffes")]
    want = _brute(docs)
    assert len(want) > 2
    assert {tuple(r) for r in sv.group_variants(spark.createDataFrame([("", "", d, t) for d, t in docs], SCHEMA)).collect()} == want


def test_batches_keep_words_apart():
    total = defaultdict(int)
    sv._CountWords(6)._add(total, 1, "apples apples pears")
    assert sum(total.values()) == 2


def test_no_vocabulary_is_broadcast(spark):
    """Small files may hold many words: no join gathers them in the driver."""
    docs = spark.createDataFrame([("w", "s", i, "colour colours color flavour flavours") for i in range(9)], SCHEMA)
    words = sv.materialize(sv.count_words(docs), "words")
    for table in (sv.near_pairs(words), sv.group_variants(docs)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = sv.near_pairs(words)
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
