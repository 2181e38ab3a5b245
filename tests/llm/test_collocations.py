"""Collocations: transducers against plain counters, the operator against plain Python, odd rows."""

import glob
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracelens.llm import collocations as co

SCHEMA = "phrase string, rank int, lang string, text string"


def _plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _counts(texts):
    f, n = Counter(), 0
    for text in texts:
        for piece in re.split("[.,;:!?\n-\r]", _plain(text)):
            ws = re.findall("[^ \t]+", piece)
            n += len(ws)
            for size in (1, 2, 3):
                for i in range(len(ws) - size + 1):
                    f[tuple(ws[i:i + size])] += 1
    return f, n


def _brute(rows, least=10, top=2000):
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang["und" if lang is None else lang].append(text)
    out = set()
    for lang, texts in by_lang.items():
        f, n = _counts(texts)
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            longer = [b for h, b in cand.items() if len(h) > len(g) and g in {h[i:i + len(g)] for i in range(len(h))}]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


def _rows(seed, n=80):
    r = random.Random(seed)
    vocab = ["a", "ab", "é", "été", "B", "the", "\x01x", "a\x01", "ß", "zz", "#"]
    out = []
    for _ in range(n):
        words = [r.choice(vocab[:r.randint(2, len(vocab))]) for _ in range(r.randint(0, 60))]
        out.append((r.choice(["en", "fr", None]), "".join(w + r.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for w in words)))
    return out


def _table(spark, rows):
    return spark.createDataFrame([("p", 1, lang, text) for lang, text in rows], SCHEMA)


def _as_dict(c):
    words = c.words.to_pylist()
    return {tuple(words[i] for i in g): int(n) for by_place, ns in zip(c.grams(), c.weights()) for *g, n in zip(*by_place, ns) if n}


def test_transducer_holds_all_phrases():
    for seed in range(4):
        texts = [t for _, t in _rows(seed)]
        c, n = co.transducer("\n".join(texts).encode())
        assert (_as_dict(c), n) == _counts(texts)
        for share in (True, False):
            assert _as_dict(co.Counts.from_bytes(c.to_bytes(share))) == _as_dict(c)


def test_equal_states_are_held_once():
    c, _ = co.transducer(b"\n".join(b"w%03d x y" % i for i in range(500)))
    assert len(c.to_bytes(True)) < len(c.to_bytes(False))
    offsets = np.array([0, 2, 4, 4, 5, 7])
    state, kept, (labels, weights) = co._shared(offsets, [np.array([1, 2, 1, 2, 9, 1, 2]), np.array([5, 6, 5, 6, 1, 5, 7])], True)
    arcs = [(labels[kept[s]:kept[s + 1]].tolist(), weights[kept[s]:kept[s + 1]].tolist()) for s in state]
    assert arcs == [([1, 2], [5, 6]), ([1, 2], [5, 6]), ([], []), ([9], [1]), ([1, 2], [5, 7])] and len(kept) == 5


def test_split_and_union_are_inverse():
    texts = [t for _, t in _rows(9, 60)]
    c, _ = co.transducer("\n".join(texts).encode())
    whole = _as_dict(c)
    keys = sorted(whole)
    r = random.Random(1)
    bounds = sorted({tuple((list(k) + ["", ""])[:3]) for k in r.sample(keys, 12)} | {("a", "zzz", "q"), ("~", "", ""), ("a", "a\x01", "")})
    parts = list(co.split_at(c, bounds))
    for number, p in parts:
        for k in _as_dict(p):
            assert sum(not (k < b if len(k) == 3 else k <= b[:len(k)]) for b in bounds) == number
    assert sum(len(_as_dict(p)) for _, p in parts) == len(whole)
    assert _as_dict(co.union([co.Counts.from_bytes(p.to_bytes(False)) for _, p in parts])) == whole


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "sample_every": 8, "range_arcs": 40}])
def test_operator_equals_plain_python(spark, options):
    rows = _rows(3) + _rows(4)
    got = [tuple(r) for r in co.top_collocations(_table(spark, rows), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_top_and_ties(spark):
    rows = _rows(3) + _rows(4)
    got = {tuple(r) for r in co.top_collocations(_table(spark, rows), top=3).collect()}
    assert got == _brute(rows, top=3)


def test_scores_are_exact():
    a = np.array([3, 10**12, 7 * 10**12], np.int64)
    l, r = a + np.array([1, 10**3, 5]), a * 2 + 1
    assert co.scores(a, l, r).tolist() == [10**6 * x * x // (y * z) for x, y, z in zip(a.tolist(), l.tolist(), r.tolist())]


def test_odd_rows(spark):
    long = "one two three four " * 40_000
    rows = [(None, None), ("en", ""), ("en", "...,,,"), ("en", long), ("en", long), ("fr", "x" * 300_000 + " y"), (None, "a b " * 10), ("de", "\x00 \x01 " * 12)]
    assert {tuple(r) for r in co.top_collocations(_table(spark, rows)).collect()} == _brute(rows)
    assert co.top_collocations(_table(spark, rows).limit(0)).count() == 0


def test_shards_are_cut_into_few_pieces(spark, monkeypatch):
    """Many ranges: a shard is cut at bundles of them, the united ranges are those of single cuts, and units join what is left."""
    options = {"shard_bytes": 300, "sample_every": 2, "range_arcs": 8}
    rows = _rows(3) + _rows(4)
    shards = co.count_shards(_table(spark, rows), shard_bytes=300, sample_every=2)
    bounds = co.range_bounds(shards, 2, 8)
    held = []
    for most in (1, 16):
        monkeypatch.setattr(co, "MOST_BUNDLED", most)
        united = co.unite_ranges(shards, bounds, 10, 8)
        found = {(r.lang, r.range): _as_dict(co.Counts.from_bytes(r.counts)) for r in united.collect()}
        held.append({k: v for k, v in found.items() if v})
    sizes = co.bundle_sizes(bounds)
    assert max(sizes.values()) > 1 and held[0] == held[1]
    coarse = {lang: b[sizes[lang] - 1::sizes[lang]] for lang, b in bounds.items()}
    fine, few = [shards.select("lang", "counts").mapInArrow(co._Split(b), co.RANGES).count() for b in (bounds, coarse)]
    assert 2 * few < fine
    units, starts = co.units_of(united, bounds, 20)
    assert all(len(starts.get(lang, [])) < len(b) for lang, b in bounds.items())
    got = [tuple(r) for r in co.top_collocations(_table(spark, rows), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def _alike(n):
    """Shards of one language: the same vocabulary in other orders."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    maker = co._Shards(1 << 20, 64)
    rows = [maker._row("en", [" ".join(r.choices(vocab, k=600)).encode()]) for _ in range(n)]
    return [co.Counts.from_bytes(row.column("counts")[0].as_py()) for row in rows], [s for row in rows for s in row.column("samples")[0].as_py()]


def test_ranges_stay_even_with_many_like_shards():
    """Samples at the same places of every shard left ranges between them that grew with the number of shards."""
    shards, samples = _alike(120)
    bounds = sorted({tuple((s.split("\t") + ["", ""])[:3]) for s in sorted(samples)[::30]})
    arcs = Counter()
    for shard in shards:
        for number, part in co.split_at(shard, bounds):
            arcs[number] += sum(len(n) for n in part.weights())
    assert len(arcs) > 50 and max(arcs.values()) < 2 * 30 * 64


def test_small_shards_are_sampled():
    """Shards with fewer phrases than lie between samples are sampled in their share."""
    maker = co._Shards(1 << 20, 4096)
    rows = [maker._row("en", [(" ".join(f"w{i * 997 + j}" for j in range(200))).encode()]) for i in range(200)]
    n = sum(len(row.column("samples")[0]) for row in rows)
    assert 10 < n < 60                                     # 119,400 phrases


def test_union_takes_a_bundle_batch_by_batch():
    """A bundle's pieces are never asked for all at once, and results leave range by range."""
    shards, samples = _alike(30)
    bounds = sorted({tuple((s.split("\t") + ["", ""])[:3]) for s in sorted(samples)[::20]})[:3]
    raws = [shard.to_bytes(False) for shard in shards]
    unite = co._Unite({"en": bounds}, {"en": 4}, 2, 3000)
    alive, most = [], 0

    def batches():
        nonlocal most
        for raw in raws:
            alive.append(len(raw))
            most = max(most, len(alive))
            yield pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([0], pa.int32()), pa.array([raw], pa.binary())], schema=co.arrow_schema(co.RANGES))
            alive.pop()

    out = list(unite(batches()))
    assert most == 1 and [row.column("range")[0].as_py() for row in out] == [0, 1, 2, 3] and all(row.num_rows == 1 for row in out)
    total = Counter()
    for shard in shards:
        total.update(_as_dict(shard))
    assert {k: v for row in out for k, v in _as_dict(co.Counts.from_bytes(row.column("counts")[0].as_py())).items()} == {k: v for k, v in total.items() if v >= 2}


def test_transducers_are_written_in_small_pages(spark):
    """A few large rows make row groups and pages of their own, and no codec holds them."""
    r = random.Random(2)
    rows = [("en", 1, 1, [], r.randbytes(3 << 20)) for _ in range(8)]
    written = co.written(spark.createDataFrame(rows, co.SHARDS).coalesce(1), "pages")
    assert {(x.lang, bytes(x.counts)) for x in written.collect()} == {("en", x[4]) for x in rows}
    path, = glob.glob(written.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(path).metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert len(groups) > 1 and all(g.num_rows <= 4 for g in groups)
    assert {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"UNCOMPRESSED"}
