"""Phrase collocations counted with weighted acyclic automata.

A count transducer (``Counts``) reads a phrase word by word and gives its number of
occurrences: states in levels, arcs sorted by word, a weight on each arc, and one
copy of every set of outgoing arcs that several states share.  It is built from
sorted n-grams, so each state is complete once the prefix has moved on.

1. Shards: every task cuts its texts into words and builds a transducer per language
   and about ``SHARD_BYTES`` of text.  They are written, with regular samples of
   their phrases.
2. Union by prefix range: the samples cut the sorted phrases of a language into
   ranges of about equal numbers of arcs (a range may begin inside the phrases
   of one word or of one pair of words, so no word is a hot key).  The shards' pieces of a range are
   united and their weights summed; phrases below the wanted count go.  A task
   unites a bundle of neighbouring ranges one after the other, so a shard is cut
   into few pieces however many ranges there are.  What is left is small:
   neighbouring ranges are joined into units before parts are looked up.
3. Part lookups by composition: a candidate's parts begin with other words, so
   they lie in other units.  Each unit sends the acceptor of its distinct parts
   to the units that hold them, where it is composed with the count transducer;
   the weighted result goes back.  A part is sent once per pair of units
   however many candidates end in it.
4. Scores are exact (Python integers beyond 63 bits).

Defined cases: a null text is empty, a null language is ``und``; repeated rows
count again; a language without candidates has no rows; an empty table gives no
rows; ties as the contract orders them; columns other than those named are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, ensure_checkpoint_dir, materialize, to_batch

NO_LANGUAGE = "und"

MIN_COUNT = 10
TOP = 2000

SHARD_BYTES = 2 << 20
SAMPLE_EVERY = 16_384
RANGE_ARCS = 500_000
# A language's ranges are united in about this many bundles, or in bundles of MOST_BUNDLED ranges.
BUNDLES = 32
MOST_BUNDLED = 16
# Arcs kept in a unit of part lookups.
UNIT_ARCS = 100_000
# Acceptors composed with a unit in one go.
ASKED_AT_ONCE = 64

# Rows that hold transducers are sent to Python workers by size, a few at a time.
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20
# Their Parquet files are read a few rows at a time (the reader holds a whole batch of rows, each a transducer) and
# written in small row groups (the writer holds a whole group).  Sizes are looked at from the first row on: by default
# only after 100 rows, so that a file was one page, which the codec held twice outside the heap.  Transducers are
# compressed already, so the files are not.
READ_ROWS_KEY = "spark.sql.parquet.columnarReaderBatchSize"
READ_ROWS = 8
ROW_GROUP_BYTES = 8 << 20
WRITE_OPTIONS = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false",
                 "compression": "uncompressed"}


# ---------------------------------------------------------------------------
# The transducer
# ---------------------------------------------------------------------------

def _shared(offsets: np.ndarray, columns: list[np.ndarray], share: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """States with equal arcs once: the state of each arc list, and the offsets and columns of the states kept."""
    sizes = np.diff(offsets)
    if not share or not len(sizes):
        return np.arange(len(sizes)), offsets, columns
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    code = np.full(len(place), 7, np.uint64)
    for c in [place, *columns]:
        code = (code ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    sums = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
    code = (sums[offsets[1:]] - sums[offsets[:-1]]) ^ sizes.astype(np.uint64)
    _, first, state = np.unique(code, return_index=True, return_inverse=True)
    # Equal codes are only believed where the arcs are equal.
    twin = first[state]
    fits = sizes[twin] == sizes
    arcs = np.repeat(fits, sizes)
    other = np.where(arcs, np.repeat(offsets[:-1][twin], sizes) + place, np.arange(offsets[-1]))
    same = np.ones(len(place), bool)
    for c in columns:
        same &= c == c[other]
    bad = ~fits | (np.add.reduceat(np.r_[~same, False].astype(np.int64), np.minimum(offsets[:-1], len(same))) * (sizes > 0) > 0)
    kept = np.unique(np.r_[first, np.flatnonzero(bad)])
    state = np.searchsorted(kept, np.where(bad, np.arange(len(sizes)), twin))
    keep = sizes[kept]
    at = np.repeat(offsets[:-1][kept], keep) + np.arange(keep.sum()) - np.repeat(np.r_[0, np.cumsum(keep)[:-1]], keep)
    return state, np.r_[0, np.cumsum(keep)], [c[at] for c in columns]


class Counts:
    """Weights of phrases of one to three words.

    ``words`` are sorted; phrases are held as sorted arrays of word numbers:
    ``one`` with weights ``n1``; ``two`` as (place in ``one``, word) with ``n2``; ``three`` as
    (place in ``two``, word) with ``n3``.  A weight of 0 marks a prefix that is not a phrase of its own here.
    """

    def __init__(self, words, one, n1, two, n2, three, n3):
        self.words, self.one, self.n1, self.two, self.n2, self.three, self.n3 = words, one, n1, two, n2, three, n3

    @classmethod
    def of(cls, words: pa.Array, one: tuple, two: tuple, three: tuple) -> Counts:
        """From unsorted arcs per level that may repeat; equal ones add up.

        ``one`` is (word, weight); ``two`` and ``three`` are (place in the level
        above as given, word, weight).  Word numbers are places in the sorted ``words``.
        """
        v = max(1, len(words))
        n1 = np.bincount(one[0], minlength=v)
        held = n1 > 0
        sums = np.zeros(v, np.int64)
        labels, sums_of, _ = _summed(one[0], one[1])
        sums[labels] = sums_of
        place = np.cumsum(held) - 1
        codes = place[one[0][two[0]]] * v + two[1]
        two_codes, n2, at2 = _summed(codes, two[2], inverse=True)
        three_codes, n3, _ = _summed(at2[three[0]] * v + three[1], three[2])
        return cls(words, np.flatnonzero(held), sums[held], (two_codes // v, two_codes % v), n2, (three_codes // v, three_codes % v), n3)

    def grams(self) -> list[tuple[np.ndarray, ...]]:
        """Word numbers by position of the phrases of each length."""
        a2, b2 = self.one[self.two[0]], self.two[1]
        return [(self.one,), (a2, b2), (a2[self.three[0]], b2[self.three[0]], self.three[1])]

    def weights(self) -> list[np.ndarray]:
        return [self.n1, self.n2, self.n3]

    def part(self, keep: list[np.ndarray]) -> Counts:
        """The phrases marked, with their prefixes and only the words they use."""
        three = np.flatnonzero(keep[2])
        with2 = keep[1].copy()
        with2[self.three[0][three]] = True
        two = np.flatnonzero(with2)
        with1 = keep[0].copy()
        with1[self.two[0][two]] = True
        one = np.flatnonzero(with1)
        return self._taken(one, self.n1[one] * keep[0][one], two, self.n2[two] * keep[1][two], three, self.n3[three])

    def cut(self, at: list[tuple[int, int]]) -> Counts:
        """The phrases in a run of each level, with their prefixes (which may begin before the run)."""
        (s1, e1), (s2, e2), (s3, e3) = at
        lo2, hi2 = (min(s2, self.three[0][s3]), max(e2, self.three[0][e3 - 1] + 1)) if e3 > s3 else (s2, e2)
        lo1, hi1 = (min(s1, self.two[0][lo2]), max(e1, self.two[0][hi2 - 1] + 1)) if hi2 > lo2 else (s1, e1)
        # Only what lies in the run is touched: a shard is cut into very many.
        one, two, three = self.one[lo1:hi1], self.two[1][lo2:hi2], self.three[1][s3:e3]
        n1, n2 = np.zeros(hi1 - lo1, np.int64), np.zeros(hi2 - lo2, np.int64)
        n1[s1 - lo1:e1 - lo1], n2[s2 - lo2:e2 - lo2] = self.n1[s1:e1], self.n2[s2:e2]
        used, number = np.unique(np.concatenate([one, two, three]), return_inverse=True)
        one, two, three = np.split(number, [len(one), len(one) + len(two)])
        return Counts(self.words.take(pa.array(used)), one, n1, (self.two[0][lo2:hi2] - lo1, two), n2,
                      (self.three[0][s3:e3] - lo2, three), self.n3[s3:e3])

    def _taken(self, one, n1, two, n2, three, n3) -> Counts:
        """Sorted arcs of each level that include their prefixes."""
        used = np.zeros(len(self.words), bool)
        for level in (self.one[one], self.two[1][two], self.three[1][three]):
            used[level] = True
        number = np.cumsum(used) - 1
        place1, place2 = np.zeros(len(self.one), np.int64), np.zeros(len(self.n2), np.int64)
        place1[one], place2[two] = np.arange(len(one)), np.arange(len(two))
        return Counts(self.words.filter(pa.array(used)), number[self.one[one]], n1, (place1[self.two[0][two]], number[self.two[1][two]]), n2,
                      (place2[self.three[0][three]], number[self.three[1][three]]), n3)

    def to_bytes(self, share: bool = True) -> bytes:
        """Arrays of the states' arcs; with ``share`` equal states are held once."""
        off3 = np.searchsorted(self.three[0], np.arange(len(self.n2) + 1))
        state3, off3, (lab3, n3) = _shared(off3, [self.three[1], self.n3], share)
        off2 = np.searchsorted(self.two[0], np.arange(len(self.n1) + 1))
        state2, off2, (lab2, n2, to3) = _shared(off2, [self.two[1], self.n2, state3], share)
        arrays = [self.one, self.n1, state2, off2, lab2, n2, to3, off3, lab3, n3]
        arrays = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays]
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([_one_list(x) for x in [self.words, *map(pa.array, arrays)]], names=[str(i) for i in range(len(arrays) + 1)])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Counts:
        batch = pa.ipc.open_stream(raw).read_next_batch()
        words = batch.column(0).flatten()
        one, n1, state2, off2, lab2, n2, to3, off3, lab3, n3 = (x.flatten().to_numpy().astype(np.int64) for x in batch.columns[1:])
        at1, arc2 = _spread(state2, off2)
        at2, arc3 = _spread(to3[arc2], off3)
        return cls(words, one, n1, (at1, lab2[arc2]), n2[arc2], (at2, lab3[arc3]), n3[arc3])

    def find(self, others: list[Counts]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Weights that this transducer gives to the one- and two-word phrases of each of the others (0: none)."""
        if not others:
            return
        # Words of all the others are looked up at once, so that this side's words are hashed once.
        numbers = _numbers(self.words, pa.concat_arrays([other.words for other in others]))
        v = max(1, len(self.words))
        own, weights1, weights2 = self.two[0] * v + self.two[1], np.r_[self.n1, 0], np.r_[self.n2, 0]
        for other, number in zip(others, np.split(numbers, np.cumsum([len(other.words) for other in others])[:-1])):
            at = _search(self.one, number[other.one])
            first, second = at[other.two[0]], number[other.two[1]]
            at2 = _search(own, np.where((first >= 0) & (second >= 0), first * v + second, -1))
            yield np.where(at >= 0, weights1[at], 0), np.where(at2 >= 0, weights2[at2], 0)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _spread(states: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For arcs reached through shared states: who leads there, and which arc it is."""
    sizes = np.diff(offsets)[states] if len(states) else np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    lead = np.repeat(np.arange(len(states)), sizes)
    return lead, np.repeat(offsets[states] - before, sizes) + np.arange(sizes.sum())


def _summed(codes: np.ndarray, weights: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct codes in order, the sum of the weights of each and, if asked, where each code went."""
    if not len(codes):
        return codes, weights, codes
    order = np.argsort(codes)
    ordered = codes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    at = None
    if inverse:
        at = np.empty(len(codes), np.int64)
        at[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    return ordered[starts], np.add.reduceat(weights[order], starts), at


def _search(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


def _numbers(words: pa.Array, other: pa.Array) -> np.ndarray:
    """The numbers that ``words`` gives to other words (-1: unknown)."""
    return pc.fill_null(pc.index_in(other, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def union(parts: list[Counts]) -> Counts:
    """All phrases of the parts, weights summed."""
    if len(parts) == 1:
        return parts[0]
    # All words are numbered in one pass over the parts.
    encoded = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    words = encoded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    numbers = np.split(rank[encoded.indices.to_numpy()], np.cumsum([len(p.words) for p in parts])[:-1])
    levels: list[list] = [[], [], []]
    before1 = before2 = 0
    for p, number in zip(parts, numbers):
        levels[0].append((number[p.one], p.n1))
        levels[1].append((p.two[0] + before1, number[p.two[1]], p.n2))
        levels[2].append((p.three[0] + before2, number[p.three[1]], p.n3))
        before1, before2 = before1 + len(p.one), before2 + len(p.n2)
    return Counts.of(words, *[tuple(np.concatenate(x) for x in zip(*level)) for level in levels])


READ_SETTINGS = {READ_ROWS_KEY: str(READ_ROWS)}
BATCH_SETTINGS = {BATCH_BYTES_KEY: str(BATCH_BYTES)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings; its own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for rows that hold transducers: in small row groups."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WRITE_OPTIONS).parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------------------
# Shards
# ---------------------------------------------------------------------------

# Blanks become spaces, what ends a piece becomes a line break between spaces, A-Z become a-z.
_PLAIN = bytes(ord("\n") if chr(c) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if chr(c) == "\t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(raw: bytes) -> pa.Array:
    """The words of texts, in order; a line break ends a piece."""
    plain = raw.translate(_PLAIN).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([plain], pa.large_string()), " ").flatten()
    return tokens.filter(pc.not_equal(tokens, ""))


def transducer(raw: bytes) -> tuple[Counts, int]:
    """Counts of all phrases of up to three words within the pieces of texts (joined by line breaks), and the number of words."""
    encoded = tokens_of(raw).dictionary_encode()
    words = encoded.dictionary
    order = pc.sort_indices(words)
    order = order.filter(pc.not_equal(words.take(order), "\n"))
    rank = np.full(len(words), -1, np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    t = rank[encoded.indices.to_numpy()]
    v, ok = max(1, len(order)), t >= 0
    n1 = np.bincount(t[ok], minlength=len(order))
    at2 = np.flatnonzero(ok[:-1] & ok[1:])
    two, n2, to = _summed(t[at2] * v + t[at2 + 1], np.ones(len(at2), np.int64), inverse=True)
    more = np.flatnonzero(ok[at2[:-1] + 2] & (np.diff(at2) == 1)) if len(at2) else at2
    three = np.sort(to[more] * v + t[at2[more] + 2])
    starts = np.flatnonzero(np.r_[True, three[1:] != three[:-1]]) if len(three) else np.zeros(0, np.int64)
    n3 = np.diff(np.r_[starts, len(three)])
    three = three[starts]
    counts = Counts(words.take(order).cast(pa.string()), np.arange(len(order)), n1, (two // v, two % v), n2, (three // v, three % v), n3)
    return counts, int(ok.sum())


SHARDS = "lang string, words bigint, arcs bigint, samples array<string>, counts binary"


class _Shards:
    """A transducer per language for about every ``shard_bytes`` of a task's texts."""

    def __init__(self, shard_bytes: int, sample_every: int):
        self.shard_bytes, self.sample_every = shard_bytes, sample_every
        self.schema = arrow_schema(SHARDS)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        total = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                raw, lang = text.as_py(), NO_LANGUAGE if lang is None else lang
                if not raw:
                    continue
                held[lang].append(raw)
                size[lang] += len(raw)
                total += len(raw)
                while size[lang] >= self.shard_bytes or total >= 4 * self.shard_bytes:
                    full = max(size, key=size.get)
                    total -= size.pop(full)
                    yield self._row(full, held.pop(full))
        for lang, parts in held.items():
            yield self._row(lang, parts)

    def _row(self, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        raw = b"\n".join(texts)
        counts, n_words = transducer(raw)
        samples = []
        # Each shard and level begins elsewhere: shards of one language are alike, and samples at the same places
        # would lie close together, with ranges between them that grow with the number of shards.
        code = zlib.crc32(raw)
        for by_place in counts.grams():
            code = zlib.crc32(b"next", code)
            picked = [counts.words.take(pa.array(g[code % self.sample_every::self.sample_every])).to_pylist() for g in by_place]
            samples += ["\t".join(phrase) for phrase in zip(*picked)]
        arcs = sum(len(n) for n in counts.weights())
        pa.default_memory_pool().release_unused()
        return to_batch({"lang": [lang], "words": [n_words], "arcs": [arcs], "samples": [samples], "counts": [counts.to_bytes(share=False)]}, self.schema)


def count_shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES,
                 sample_every: int = SAMPLE_EVERY) -> DataFrame:
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_Shards(shard_bytes, sample_every), SHARDS), "count-shards")


# ---------------------------------------------------------------------------
# Union by prefix range
# ---------------------------------------------------------------------------

Bound = tuple[str, str, str]


class _EveryNth:
    def __init__(self, step: int):
        self.step = step

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(batch.num_rows)
            yield batch.take(pa.array(at[(at + seen) % self.step == 0]))
            seen += batch.num_rows


def range_bounds(shards: DataFrame, sample_every: int = SAMPLE_EVERY, range_arcs: int = RANGE_ARCS) -> dict[str, list[Bound]]:
    """Where ranges begin, per language: about one phrase per ``range_arcs`` arcs (a few words each, so a small table)."""
    samples = shards.select("lang", F.explode("samples").alias("phrase"))
    step = max(1, range_arcs // sample_every)
    cuts = samples.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(_EveryNth(step), "lang string, phrase string")
    out: dict[str, set] = defaultdict(set)
    for r in cuts.toLocalIterator():
        words = r["phrase"].split("\t")
        out[r["lang"]].add(tuple(words + [""] * (3 - len(words))))
    return {lang: sorted(found) for lang, found in out.items()}


def split_at(counts: Counts, bounds: list[Bound]) -> Iterator[tuple[int, Counts]]:
    """The non-empty parts of a transducer by range (phrases before the first bound are range 0)."""
    if not bounds:
        yield 0, counts
        return
    # Bounds as numbers on the scale of this transducer's words: 2 i + 1 is word i, 2 i lies before it, -1 is no word.
    words = counts.words
    names = pa.array(sorted({w for b in bounds for w in b if w}), pa.string())
    both = pa.concat_arrays([words, names])
    sorted_rank = pc.rank(both, "ascending", tiebreaker="min").to_numpy().astype(np.int64)
    own, their = sorted_rank[:len(words)], sorted_rank[len(words):]
    at = np.searchsorted(own, their)
    known = np.r_[own, -1][at] == their
    number = dict(zip(names.to_pylist(), (2 * at + known).tolist()))
    number[""] = -1
    x, y, z = (np.array([number[b[i]] for b in bounds], np.int64) for i in range(3))
    # How many phrases of each level lie before each bound; levels are sorted, so ranges are runs.
    e1 = np.searchsorted(2 * counts.one + 1, x, side="right")           # a prefix comes before its phrases
    head = np.searchsorted(2 * counts.one + 1, x)
    known1 = (e1 > head)
    base = 2 * len(words) + 3
    keys2 = counts.two[0] * base + 2 * counts.two[1] + 2
    e2 = np.where(known1, np.searchsorted(keys2, head * base + y + 1, side="right"), np.searchsorted(keys2, head * base))
    low2 = np.where(known1, np.searchsorted(keys2, head * base + y + 1), e2)
    known2 = e2 > low2
    keys3 = counts.three[0] * base + 2 * counts.three[1] + 2
    e3 = np.where(known2, np.searchsorted(keys3, low2 * base + z + 1), np.searchsorted(keys3, e2 * base))
    ends = [np.r_[0, np.maximum.accumulate(e), size] for e, size in zip((e1, e2, e3), (len(counts.n1), len(counts.n2), len(counts.n3)))]
    for number_of in range(len(bounds) + 1):
        runs = [(int(e[number_of]), int(e[number_of + 1])) for e in ends]
        if any(b > a and n[a:b].any() for (a, b), n in zip(runs, counts.weights())):
            yield number_of, counts.cut(runs)


class _Split:
    def __init__(self, bounds: dict[str, list[Bound]]):
        self.bounds, self.schema = bounds, arrow_schema("lang string, range int, counts binary")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts")):
                for number, part in split_at(Counts.from_bytes(raw.as_py()), self.bounds.get(lang, [])):
                    yield to_batch({"lang": [lang], "range": [number], "counts": [part.to_bytes(share=False)]}, self.schema)
                pa.default_memory_pool().release_unused()


RANGES = "lang string, range int, counts binary"
UNITED = "lang string, range int, arcs bigint, counts binary"


class _Unite:
    """One transducer for each range of a bundle, without the phrases below ``min_count``.

    Pieces come a few at a time.  They are united up to about ``range_arcs`` arcs, the result is cut
    at the ranges and packed, and what a range got is united: unpacked are no more than a range's arcs at once.
    """

    def __init__(self, bounds: dict[str, list[Bound]], bundles: dict[str, int], min_count: int, range_arcs: int):
        self.bounds, self.bundles, self.min_count, self.range_arcs = bounds, bundles, min_count, range_arcs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[str, int], list[bytes]] = defaultdict(list)
        for lang, bundle, whole in self._united(batches):
            # The bounds inside the bundle; its pieces hold nothing outside it.
            size = self.bundles.get(lang, 1)
            inner = self.bounds.get(lang, [])[bundle * size:bundle * size + size - 1]
            for number, part in split_at(whole, inner):
                pieces[lang, bundle * size + number].append(part.to_bytes(share=False))
            del whole, part
            pa.default_memory_pool().release_unused()
        for lang, number in sorted(pieces):
            yield self._row(lang, number, union([Counts.from_bytes(raw) for raw in pieces.pop((lang, number))]))
            pa.default_memory_pool().release_unused()

    def _united(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Counts]]:
        """The pieces of a bundle, about ``range_arcs`` arcs at a time."""
        held: list[Counts] = []
        arcs = 0
        for batch in batches:
            lang, bundle = batch.column("lang")[0].as_py(), batch.column("range")[0].as_py()
            for raw in batch.column("counts"):
                held.append(Counts.from_bytes(raw.as_buffer()))
                arcs += sum(len(n) for n in held[-1].weights())
                if arcs >= self.range_arcs:
                    whole, held, arcs = union(held), [], 0
                    yield lang, bundle, whole
                    del whole
        if held:
            yield lang, bundle, union(held)

    def _row(self, lang: str, number: int, whole: Counts) -> pa.RecordBatch:
        kept = whole.part([n >= self.min_count for n in whole.weights()])
        arcs = sum(len(n) for n in kept.weights())
        return to_batch({"lang": [lang], "range": [number], "arcs": [arcs], "counts": [kept.to_bytes()]}, arrow_schema(UNITED))


def bundle_sizes(bounds: dict[str, list[Bound]]) -> dict[str, int]:
    """How many neighbouring ranges of a language one task unites: the more ranges, the more, so that shards are not cut into ever more pieces."""
    return {lang: min(MOST_BUNDLED, max(1, (len(found) + 1) // BUNDLES)) for lang, found in bounds.items()}


def unite_ranges(shards: DataFrame, bounds: dict[str, list[Bound]], min_count: int, range_arcs: int = RANGE_ARCS) -> DataFrame:
    bundles = bundle_sizes(bounds)
    coarse = {lang: found[bundles[lang] - 1::bundles[lang]] for lang, found in bounds.items()}
    parts = shards.select("lang", "counts").mapInArrow(_Split(coarse), RANGES)
    unite = _Unite(bounds, bundles, min_count, range_arcs)

    # Spark hands over a group batch by batch if the function's annotations say so.
    def united(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return unite(pieces)

    return written(parts.groupBy("lang", "range").applyInArrow(united, UNITED), "count-ranges")


def units_of(ranges: DataFrame, bounds: dict[str, list[Bound]], unit_arcs: int) -> tuple[DataFrame, dict[str, list[Bound]]]:
    """Neighbouring ranges joined into units of about ``unit_arcs`` arcs that were kept (few are), and where units begin.

    One small row per range comes to the driver.  ``range`` is then the unit; a unit's transducer is the union of its rows.
    """
    arcs = {(r["lang"], r["range"]): r["arcs"] for r in ranges.select("lang", "range", "arcs").toLocalIterator()}
    starts: dict[str, list[int]] = {}
    for lang in {lang for lang, _ in arcs}:
        found, held = [], 0
        for number in range(len(bounds.get(lang, [])) + 1):
            here = arcs.get((lang, number), 0)
            if number and held + here > unit_arcs:
                found.append(number)
                held = 0
            held += here
        starts[lang] = found
    units = ranges.select("lang", "range", "counts").mapInArrow(_Renumber(starts), RANGES)
    return units, {lang: [bounds[lang][n - 1] for n in found] for lang, found in starts.items()}


class _Renumber:
    def __init__(self, starts: dict[str, list[int]]):
        self.starts, self.schema = starts, arrow_schema(RANGES)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [int(np.searchsorted(self.starts[lang], n, side="right")) for lang, n in
                     zip(batch.column("lang").to_pylist(), batch.column("range").to_pylist())]
            yield to_batch({"lang": batch.column("lang"), "range": units, "counts": batch.column("counts")}, self.schema)


# ---------------------------------------------------------------------------
# Part lookups
# ---------------------------------------------------------------------------

def parts_of(counts: Counts) -> Counts:
    """The acceptor of all proper parts of the phrases of two and three words."""
    _, (a2, b2), (a3, b3, c3) = counts.grams()
    two, three = counts.n2 > 0, counts.n3 > 0
    a2, b2, a3, b3, c3 = a2[two], b2[two], a3[three], b3[three], c3[three]
    # Pairs hang below words, which are all parts themselves but for the last word of a pair.
    first = np.r_[a2, a3, b3]
    ones = np.r_[first, b2, c3]
    asked = np.r_[np.ones(len(a2) + len(a3), np.int64), np.zeros(len(b3), np.int64), np.ones(len(b2) + len(c3), np.int64)]
    pairs = (len(a2) + np.arange(2 * len(a3)), np.r_[b3, c3], np.ones(2 * len(a3), np.int64))
    none = np.zeros(0, np.int64)
    found = Counts.of(counts.words, (ones, asked), pairs, (none, none, none))
    found.n1, found.n2 = np.minimum(found.n1, 1), np.minimum(found.n2, 1)
    return found


ASKED = "lang string, range int, home int, asked binary"


class _Ask:
    """The acceptor of a unit's distinct parts, cut at the units that hold them."""

    def __init__(self, bounds: dict[str, list[Bound]]):
        self.bounds, self.schema = bounds, arrow_schema(ASKED)

    def __call__(self, table: pa.Table) -> pa.Table:
        lang, home = table.column("lang")[0].as_py(), table.column("range")[0].as_py()
        parts = parts_of(_own(table))
        rows = [to_batch({"lang": [lang], "range": [number], "home": [home], "asked": [part.to_bytes(share=False)]}, self.schema)
                for number, part in (split_at(parts, self.bounds.get(lang, [])) if len(parts.one) else ())]
        return pa.Table.from_batches(rows, self.schema)


def _own(rows: pa.Table) -> Counts:
    """The transducer of a unit."""
    return union([Counts.from_bytes(x.as_py()) for x in rows.column("counts")])


def _compose(_key: tuple[pa.Scalar, ...], counts: pa.Table, asked: pa.Table) -> pa.Table:
    """Every acceptor sent here, with this range's weights on it."""
    schema = arrow_schema(RANGES)
    own = _own(counts) if counts.num_rows else None
    out = []
    for begin in range(0, asked.num_rows, ASKED_AT_ONCE):
        rows = asked.slice(begin, ASKED_AT_ONCE)
        parts = [Counts.from_bytes(raw.as_py()) for raw in rows.column("asked")]
        found = own.find(parts) if own else ((part.n1 * 0, part.n2 * 0) for part in parts)
        for lang, home, part, (n1, n2) in zip(rows.column("lang").to_pylist(), rows.column("home").to_pylist(), parts, found):
            # A prefix that belongs to another range was not asked for.
            part.n1, part.n2 = n1 * (part.n1 > 0), n2 * (part.n2 > 0)
            out.append(to_batch({"lang": [lang], "range": [home], "counts": [part.to_bytes(share=False)]}, schema))
    return pa.Table.from_batches(out, schema)


PHRASES = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint, dropped boolean"


def scores(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``floor(1000000 a a / (l r))``, exact."""
    if not len(a):
        return np.zeros(0, np.int64)
    if a.max() < 3_000_000 and l.max() < 3_000_000_000 and r.max() < 3_000_000_000:
        return 1_000_000 * a * a // (l * r)
    return np.array([1_000_000 * x * x // (y * z) for x, y, z in zip(a.tolist(), l.tolist(), r.tolist())], np.int64)


def _score(_key: tuple[pa.Scalar, ...], counts: pa.Table, found: pa.Table) -> pa.Table:
    """Candidates of a range with their parts' counts; ``dropped`` rows name shorter phrases that a longer one covers."""
    schema = arrow_schema(PHRASES)
    if not counts.num_rows or not found.num_rows:
        return pa.Table.from_batches([], schema)
    own = _own(counts)
    weights = union([Counts.from_bytes(x.as_py()) for x in found.column("counts")])
    _, (a2, b2), (a3, b3, c3) = own.grams()
    two, three = own.n2 > 0, own.n3 > 0
    a2, b2, f2, a3, b3, c3, f3 = a2[two], b2[two], own.n2[two], a3[three], b3[three], c3[three], own.n3[three]
    number = _numbers(weights.words, own.words)
    v = max(1, len(weights.words))
    pairs = weights.two[0] * v + weights.two[1]

    def one(w):
        return weights.n1[_search(weights.one, number[w])]

    def pair(x, y):
        return weights.n2[_search(pairs, _search(weights.one, number[x]) * v + number[y])]

    words = own.words.to_numpy(zero_copy_only=False)
    out = []
    if len(f2):
        l, r = one(a2), one(b2)
        out.append(_rows(counts, words[a2] + " " + words[b2], f2, l, r, scores(f2, l, r), False))
    if len(f3):
        head, tail = pair(a3, b3), pair(b3, c3)
        l1, r1, l2, r2 = one(a3), tail, head, one(c3)
        s1, s2 = scores(f3, l1, r1), scores(f3, l2, r2)
        first = s1 <= s2
        text = words[a3] + " " + words[b3] + " " + words[c3]
        out.append(_rows(counts, text, f3, np.where(first, l1, l2), np.where(first, r1, r2), np.where(first, s1, s2), False))
        covered = [words[x][big] + " " + words[y][big] for x, y, n in ((a3, b3, head), (b3, c3, tail)) for big in [2 * f3 >= n]]
        names = np.unique(np.concatenate(covered).astype(object))
        zero = np.zeros(len(names), np.int64)
        out.append(_rows(counts, names, zero, zero, zero, zero, True))
    return pa.Table.from_batches(out, schema)


def _rows(counts: pa.Table, phrase, a, l, r, score, dropped: bool) -> pa.RecordBatch:
    lang = counts.column("lang")[0].as_py()
    return to_batch({"lang": [lang] * len(phrase), "phrase": pa.array(phrase, pa.string()), "a": a, "l": l, "r": r, "score": score,
                     "dropped": [dropped] * len(phrase)}, arrow_schema(PHRASES))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 shard_bytes: int = SHARD_BYTES, sample_every: int = SAMPLE_EVERY, range_arcs: int = RANGE_ARCS) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: all phrases of two or three words that occur ``min_count`` times and that no longer one covers."""
    spark = docs.sparkSession
    with settings(spark, BATCH_SETTINGS):
        shards = count_shards(docs, text_col, lang_col, shard_bytes, sample_every)
    with settings(spark, READ_SETTINGS | BATCH_SETTINGS):
        bounds = range_bounds(shards, sample_every, range_arcs)
        ranges, bounds = units_of(unite_ranges(shards, bounds, min_count, range_arcs), bounds, min(UNIT_ARCS, range_arcs))
        ask = _Ask(bounds)
        asked = ranges.groupBy("lang", "range").applyInArrow(lambda rows: ask(rows), ASKED)
        answers = ranges.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInArrow(_compose, RANGES)
        phrases = ranges.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range")).applyInArrow(_score, PHRASES)
        phrases = materialize(phrases, "phrases")
    sizes = shards.groupBy("lang").agg(F.sum("words").alias("n"))
    kept = phrases.where(~F.col("dropped")).drop("dropped").join(
        phrases.where("dropped").select("lang", "phrase").hint("merge"), ["lang", "phrase"], "left_anti")
    return kept.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` phrases of each language by score, then count, then phrase."""
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (collocations(docs, **options).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
