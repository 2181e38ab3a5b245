import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelens.llm import pii

from . import helpers


def brute(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) < 256 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(v * (1 + i % 2), 10)) for i, v in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "a@b.co", ".", "-", "_", "1", "255", "256", "0001", "+", "+1 (", ") ", " ", "\n", "٣",
                                 "4539578763621486", "4539 5787 6362 1486", "1.2.3.4", "é"]), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000, "1.2." * 50_000):
        pii.base_spans(text)


def test_dynamic_programme_equals_all_segmentations():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = 6
        cands = [(i, j, int(rng.integers(4)), 0, 0) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scores = rng.normal(0, 2, len(cands))
        best, total = 0.0, 0.0

        def walk(at, score):
            nonlocal best, total
            if at == n:
                best = max(best, score)
                total += np.exp(score)
                return
            walk(at + 1, score)
            for c, cand in enumerate(cands):
                if cand[0] == at:
                    walk(cand[1], score + scores[c])

        walk(0, 0.0)
        assert abs(sum(scores[c] for c in pii.best_segments(n, cands, scores)) - best) < 1e-9
        assert abs(pii._sums(n, cands, scores)[0] - np.log(total)) < 1e-9


def test_training_learns_looser_forms():
    texts = [f"call {a} or write to mail{a}@host{a}.org now" for a in range(40)] + [f"phone +1 (20{a % 9}) 555-01{a:02d} ok" for a in range(60)]
    w = pii.train(texts)
    base, added = pii.find_spans("please ring 1 (204) 555-0177 today", w)
    assert base == [] and [(k, a, b) for k, a, b in added] == [("phone", 12, 28)]
    assert pii.find_spans("version 4.0 of 1999 has 12 parts", w) == ([], [])


def test_report_and_mask_on_odd_rows(spark):
    rows = helpers.odd_rows() + [(20, "mail x.y@mail.example.com or +1 (212) 555-0100, 10.0.0.1; 4539578763621486")]
    table = helpers.docs(spark, rows)
    got = pii.report(table).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r.doc_id == 20)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert all(s in r.spans.split(",") for s in pii.join_spans(brute(rows[-1][1])).split(","))
    masked = pii.mask(table, chars_col="n_chars")
    assert masked.columns == table.columns
    out = {m.doc_id: m for m in masked.collect()}
    assert out[20].text == "mail [EMAIL] or [PHONE], [IP]; [CARD]" and out[20].n_chars == len(out[20].text)
    assert out[2].text is None and out[5].text == "one"


def test_empty_table(spark):
    table = helpers.docs(spark, [])
    assert pii.report(table).count() == 0 and pii.mask(table).count() == 0


def test_long_island_equals_its_lines_at_every_offset():
    w = pii.train([f"phone +1 (20{a % 9}) 555-01{a:02d} ok" for a in range(60)])
    phones = [f"1 (2{k % 90:02d}) 555-{k % 9000:04d}" for k in range(160, 400)]
    assert all(pii.find_spans(p, w)[1] == [("phone", 0, len(p))] for p in phones)
    for sep in ("\n", ", "):
        block = sep.join(phones)
        assert len(block) > 2500
        for shift in range(0, 20):
            text = "9" * shift + sep + block
            _, added = pii.find_spans(text, w)
            at = [text.index(block) + k * (len(phones[0]) + len(sep)) for k in range(len(phones))]
            assert added == [("phone", a, a + len(phones[0])) for a in at], (sep, shift)


def test_parts_equal_one_programme_over_the_island():
    w = pii.train([f"phone +1 (20{a % 9}) 555-01{a:02d} ok" for a in range(60)])
    rng = np.random.default_rng(4)
    pieces = ["1 (204) 555-0177", "x", " ", "\n", ", ", "12", "4539 5787 6362 1486", "10.0.0.1", "a@b", "555-0100", "\t", "é", "(", "+"]
    for _ in range(60):
        text = "".join(pieces[k] for k in rng.integers(0, len(pieces), 120))
        for lo, hi in pii.islands(text):
            n, cands, _ = pii._lattice(text[lo:hi])
            scores = pii._scores(text, [(i, j, k, a + lo, b + lo) for i, j, k, a, b in cands], w)
            best = sum(scores[c] for c in pii.best_segments(n, cands, scores))
            total = parts = 0.0
            for some in pii._parts(text, lo, hi):
                moved = [(i - some[0][0], j - some[0][0], *rest) for i, j, *rest in some]
                m, scores_here = max(c[1] for c in moved), pii._scores(text, moved, w)
                parts += sum(scores_here[c] for c in pii.best_segments(m, moved, scores_here))
                total += pii._sums(m, moved, scores_here)[0]
            assert abs(parts - best) < 1e-6 and abs(total - pii._sums(n, cands, scores)[0]) < 1e-6
