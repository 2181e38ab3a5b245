import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelens.llm import quality_rules as q

from . import helpers


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for j in range(len(w) - 2):
        seen.setdefault(tuple(w[j:j + 3]), []).append(j)
    rep = {j + o for at in seen.values() if len(at) > 1 for j in at for o in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x85\xa0é#%<", max_size=60))
def test_measures_equal_brute_force(text):
    assert q.measure(text)[:5] == brute(text)


def test_base_and_verdict_on_odd_rows(spark):
    rows = helpers.odd_rows()
    got = q.score(helpers.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert by == sorted((str(i), *brute(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_em_finds_the_bad_class():
    rng = np.random.default_rng(0)
    good = rng.random(5000) < 0.9
    votes = np.where(rng.random((5000, 6)) < np.where(good[:, None], 0.97, 0.35), 1, -1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fitted = q.fit_rules(patterns, counts.astype(float))
    found = q.posterior(votes, *fitted) >= 0.5
    assert (found == good).mean() > 0.97
    assert abs(fitted[0] - 0.9) < 0.03 and np.all(fitted[1] > 0.93)


def test_symbol_noise_is_rejected_and_clean_text_kept(spark):
    clean = [(i, helpers.words(150, i)) for i in range(40)]
    noisy = [(100 + i, " ".join(f"{w}%%%" if k % 2 else f"{w}### ***" for k, w in enumerate(helpers.words(150, i).split()))) for i in range(6)]
    got = {r.doc_id: r.kept for r in q.score(helpers.docs(spark, clean + noisy)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in noisy)


def test_empty_table(spark):
    assert q.score(helpers.docs(spark, [])).count() == 0
