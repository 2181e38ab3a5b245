import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelens.llm import chat_tree as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, start bigint, leaf string"
PARTS = st.lists(st.sampled_from(["\\", "#", "###", "### Assistant: ", "</turn>", " </turn>\n", ": ", "\n", "a", " "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_format_is_reversible(turns):
    text = "".join(c.format_turn(r, t) for r, t in turns)
    assert [(r, c.unescape(text[a:b])) for r, a, b in c.parse_turns(text)] == turns


def conversations(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for k in range(rng.randint(1, 6)):
            said = rng.choice(["hi", "hello there", r"\### Assistant: </turn> ok", "", "ümlaut ###"]) if k < 3 else f"only {i} {k}"
            rows.append((i, k, "user" if k % 2 == 0 else "assistant", said, 0, "x"))
    rows += [(100 + i, k, r, t, 0, "x") for i in range(30) for k, (r, t) in enumerate([("user", "same"), ("assistant", "answer")])]
    rows += [(200, 0, None, None, 0, "x"), (201, None, "assistant", "no turn", 0, "x"), (201, 1, "assistant", "one", 0, "x"),
             (201, 1, "assistant", "one", 0, "x"), (None, 0, "user", "nobody", 0, "x"), (202, 0, "assistant", "y" * 300_000, 0, "x")]
    return rows


def by_conversation(rows):
    out = {}
    for i, k, r, t, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(i, []).append((r or "", t or ""))
    return out


def test_read_back_equals_input(spark):
    rows = conversations()
    expected = by_conversation(rows)
    got = c.read_back(c.build(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    assert len(got) == len(expected)
    for r in got:
        turns = expected[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(c.format_turn(*t)) for t in turns)


def test_tree_layout(spark):
    rows = conversations(3)
    tree = c.build(spark.createDataFrame(rows, SCHEMA).repartition(4))
    segments = sorted(tree.segments.collect(), key=lambda s: s.start)
    # The stream has no gaps, and shared tokens are in it once.
    at = 0
    for s in segments:
        assert s.start == at and s.text
        at += len(s.text)
    prefixes = {tuple(t[:k + 1]) for t in by_conversation(rows).values() for k in range(len(t))}
    assert at == sum(len(c.format_turn(*p[-1])) for p in prefixes)
    stream = "".join(s.text for s in segments)
    formatted = {i: "".join(c.format_turn(*x) for x in t) for i, t in by_conversation(rows).items()}
    for s in segments:
        # What a segment attends to, then itself, is its conversation; positions count the path.
        above = "".join(stream[a:b] for a, b in zip(s.attend[::2], s.attend[1::2], strict=True))
        assert above + s.text == formatted[s.segment_id] and s.position == len(above)
        assert all(b <= s.start for b in s.attend)


def test_empty_table(spark):
    assert c.read_back(c.build(spark.createDataFrame([], SCHEMA))).count() == 0
