import random

import pytest

from tracelens.llm import queries, token_counts

from . import helpers

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    t = tokenizers.Tokenizer.from_file(queries.token_file())
    t.no_truncation()
    t.no_padding()
    return t


def test_blank_runs_add_up(tokenizer):
    """The property that the operator rests on: tokens of a text are those of its runs between ASCII blanks."""
    rng = random.Random(2)
    bits = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "\x85", " ", "\xa0", "İ", "Σ", "ς", "ΑΣ", "é", "́", "'s", "'LL", "ﬁ", "Å",
            "1", "٣", "²", "中", "한", "가", "👍", "&", "\x1c", "\t", "<|endof", "text|>", "\r", "\x0b"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert len(tokenizer.encode(s, add_special_tokens=False).ids) == sum(
            len(tokenizer.encode(w.decode(), add_special_tokens=False).ids) for w in s.encode().split())


def test_counts_equal_the_library(spark, tokenizer):
    rows = helpers.odd_rows() + [(50, "A <|endoftext|> b<|startoftext|>c"), (51, "Ünïcode ΑΣ don't 12345")]
    table = helpers.docs(spark, rows).repartition(3)
    expected = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for block_bytes in (token_counts.BLOCK_BYTES, 1000):
        got = token_counts.count_tokens(table, queries.token_file(), block_bytes=block_bytes).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected


def test_limit_and_empty_table(spark):
    got = token_counts.report(helpers.docs(spark, [(1, "a b c"), (2, "a")]), queries.token_file(), limit=1).collect()
    assert {r.doc_id: r.over_limit for r in got} == {1: True, 2: False}
    assert token_counts.report(helpers.docs(spark, []), queries.token_file()).count() == 0


def test_pack_round_trip():
    import numpy as np
    idx, freq = np.array([70_000, 3, 5, 1_000_000]), np.array([1, 300, 2, 70_000])
    a, b = token_counts.unpack(token_counts.pack(idx, freq))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(idx.tolist(), freq.tolist(), strict=True))
