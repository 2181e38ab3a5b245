"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items are put into one automaton whose
paths are the word sequences that occur in some item.  Every document streams
through it word by word; the automaton keeps the longest suffix of what was
read that is a part of an item.  A match of ``window`` words (or a whole item,
if it is shorter) marks its words as hit.

Defined results: null and empty texts have no words; an item without words is
ignored; an empty benchmark marks nothing; repeated rows get equal results and
item ids that occur twice count once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize

WINDOW = 10
# Words of benchmark text in one automaton (about 1 kB each in a worker); more items make more automata,
# each of which the documents pass in its own step.
WORDS_PER_AUTOMATON = 300_000
MAX_COVERAGE = 0.8

# ASCII upper case is lowered, other ASCII besides digits and letters separates words, the rest is kept.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else (c | 32 if chr(c).isupper() else 32)
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the words of several items."""

    def __init__(self, items: list[tuple[int | str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set] = defaultdict(set)
        self.short: dict[int, set] = defaultdict(set)
        for item, words in items:
            state = 0
            for w in words:
                state = self._extend(state, self.words.setdefault(w, len(self.words)))
                owners[state].add(item)
            if 0 < len(words) < window:
                self.short[state].add(item)
        self._spread(owners)
        self.shortest = min([window, *(self.length_of_short(s) for s in self.short)])

    def length_of_short(self, state: int) -> int:
        return self.short_length[state]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _spread(self, owners: dict[int, set]) -> None:
        """Give every state of at least a window its items, and every state the short items that end it."""
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in by_length:
            up = self.link[s]
            if s in owners and self.length[up] >= self.window:
                owners[up] |= owners[s]
        self.items = {s: tuple(v) for s, v in owners.items() if self.length[s] >= self.window}
        self.short_length = {s: self.length[s] for s in self.short}
        chains: dict[int, tuple] = {}
        for s in reversed(by_length):
            own = ((self.length[s], tuple(self.short[s])),) if s in self.short else ()
            if found := own + chains.get(self.link[s], ()):
                chains[s] = found
        self.short_chain = chains

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit intervals (word positions, end exclusive) and the items that occur."""
        window, link, length, nxt = self.window, self.link, self.length, self.next
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set = set()
        # Only runs of benchmark words that are long enough can hold a match.
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for lo, hi in zip(known[::2], known[1::2], strict=True):
            if hi - lo < self.shortest:
                continue
            state = run = 0
            for i, w in enumerate(ids[lo:hi].tolist(), start=int(lo)):
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    run = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    continue
                state, run = to, run + 1
                hit = 0
                if run >= window:
                    hit, s = window, state
                    while length[link[s]] >= window:
                        s = link[s]
                    found.update(self.items.get(s, ()))
                for n, items in self.short_chain.get(state, ()):
                    if n <= run:
                        found.update(items)
                        hit = max(hit, n)
                if hit:
                    if spans and spans[-1][1] >= i + 1 - hit:
                        start = min(spans.pop()[0], i + 1 - hit)
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
                    else:
                        spans.append((i + 1 - hit, i + 1))
        return spans, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, words_per_automaton: int):
    """Items (id and words) in blocks of bounded size, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r.text)
        if not words:
            continue
        if block and size + len(words) > words_per_automaton:
            yield block
            block, size = [], 0
        block.append((r.item, words))
        size += len(words)
    if block:
        yield block


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             words_per_automaton: int = WORDS_PER_AUTOMATON):
    """Automata over the items in blocks of bounded size, one at a time on the driver."""
    for block in _blocks(benchmark, id_col, text_col, words_per_automaton):
        yield SuffixAutomaton(block, window)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
            words_per_automaton: int = WORDS_PER_AUTOMATON, keep: list[str] | None = None,
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``keep`` columns of docs, ``__text`` and the match of each row.

    Adds ``__n_words``, ``__spans`` (word positions, start and end in turn)
    and ``__items``.  One automaton is the usual case and takes one pass; with
    more, each pass adds its matches to those of the one before.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"),
                       F.lit(None).cast("bigint").alias("__n_words"),
                       F.array().cast("array<bigint>").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    first = True
    for automaton in automata(benchmark, item_id, item_text, window, words_per_automaton):
        rows = _pass(rows if first else materialize(rows, "decontaminate"), automaton)
        first = False
    return _pass(rows, SuffixAutomaton([], window)) if first else rows


def _pass(rows: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    from .common import bound_batches

    bound_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            n, spans, items = [], [], []
            old = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            for text, (before, named) in zip(batch.column("__text").to_pylist(), old, strict=True):
                words = words_of(text)
                got, found = shared.value.match(words)
                if before:
                    got = _merge(got + list(zip(before[::2], before[1::2], strict=True)))
                n.append(len(words))
                spans.append([x for s in got for x in s])
                items.append(sorted(found.union(named or ())))
            cols = [batch.column(c) for c in range(batch.num_columns - 3)]
            cols += [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=list(batch.schema.names))

    return rows.mapInArrow(run, rows.schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, **options) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    found = matches(docs.select(F.col(id_col), F.col(text_col).alias("__src")), benchmark, "__src", window,
                    keep=[id_col], **options)
    hit = F.expr("aggregate(sequence(1, greatest(1, cast(size(__spans) / 2 as int))), 0L, (n, k) -> "
                 "n + coalesce(try_element_at(__spans, 2 * k) - try_element_at(__spans, 2 * k - 1), 0L))")
    return found.select(
        F.col(id_col), F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"))


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; a blank stays where a span was cut."""
    data = text.encode("utf-8", "replace")
    folded = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded, [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:int(starts[a])])
        at = int(ends[b - 1])
    out.append(data[at:])
    return b" ".join(x for x in out if x.strip()).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE, chars_col: str | None = None, item_id: str = "item_id",
                  item_text: str = "text", words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """Documents with matching spans cut out, same columns.

    A document of which more than ``max_coverage`` of the words are hit, or of
    which nothing is left, goes; documents without a match are unchanged.
    ``chars_col`` names a column of code-point counts to bring up to date.
    The result does not depend on the number of blocks the items are dealt into.
    """
    blocks = _blocks(benchmark, item_id, item_text, words_per_automaton)
    block = next(blocks, None)
    if block is None:
        return docs
    if next(blocks, None) is None:
        return _cut(docs, SuffixAutomaton(block, window), text_col, max_coverage, chars_col)
    # Several automata: the spans of all of them are cut at once.  Cutting can bring words together, so what was
    # cut is looked at again until nothing matches; coverage is of the words at the start.
    others = [c for c in docs.columns if c != text_col]
    state = docs.withColumns({"__total": F.lit(None).cast("bigint"), "__hit": F.lit(0).cast("bigint")})
    done = []
    while True:
        found = materialize(matches(state, benchmark, text_col, window, words_per_automaton, [*others, "__total", "__hit"],
                                    item_id, item_text), "decontaminate")
        found = found.withColumn("__total", F.coalesce("__total", "__n_words"))
        done.append(found.where((F.size("__spans") == 0) & (
            (F.col("__hit") == 0) | (F.col("__n_words") > 0) & (F.col("__hit") <= max_coverage * F.col("__total")))))
        state = materialize(_trim(found.where(F.size("__spans") > 0), text_col, others), "decontaminate-rest")
        if state.isEmpty():
            break
    rows = reduce(DataFrame.union, done)
    columns = {text_col: F.col("__text").cast(docs.schema[text_col].dataType)}
    if chars_col:
        columns[chars_col] = F.when(F.col("__hit") > 0, F.length("__text")).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def _trim(found: DataFrame, text_col: str, others: list[str]) -> DataFrame:
    """Rows of ``matches`` with their spans cut out of the text and counted as hit."""
    rows = found.select(*others, "__total", "__hit", F.col("__text").alias(text_col), "__spans")

    def run(batches):
        for batch in batches:
            spans = [list(zip(x[::2], x[1::2], strict=True)) for x in batch.column("__spans").to_pylist()]
            cols = list(batch.columns)[:-3]
            hits = zip(batch.column("__hit").to_pylist(), spans, strict=True)
            cols.append(pa.array([h + sum(b - a for a, b in x) for h, x in hits], pa.int64()))
            texts = zip(batch.column(text_col).to_pylist(), spans, strict=True)
            cols.append(pa.array([clean_text(t, x) for t, x in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=list(batch.schema.names)[:-1])

    return rows.mapInArrow(run, rows.drop("__spans").schema)


def _cut(docs: DataFrame, automaton: SuffixAutomaton, text_col: str, max_coverage: float,
         chars_col: str | None) -> DataFrame:
    from .common import bound_batches

    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            stay, changed = [], {}
            for i, text in enumerate(texts):
                cut = text
                words = words_of(text)
                n = len(words)
                hit = 0
                # Cutting can bring words together, so the rest is looked at again.
                while words:
                    spans, _ = shared.value.match(words)
                    if not spans:
                        break
                    hit += sum(b - a for a, b in spans)
                    cut = clean_text(cut, spans)
                    words = words_of(cut)
                if cut is not text:
                    changed[i] = cut
                stay.append(not hit or bool(words) and hit <= max_coverage * n)
            cols = list(batch.columns)
            if changed:
                cols[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if chars is not None:
                    old = cols[chars].to_pylist()
                    cols[chars] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(old)],
                                           batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
