"""Spelling variant grouping with PartEnum signatures.

A word's letters are a multiset, seen as a binary vector with one dimension per
(letter, how many-th occurrence).  One inserted or deleted letter changes one
dimension, one replaced letter two, so words one edit apart have vectors at a
Hamming distance of at most two.  ``PartEnum`` turns that bound into equalities:
the dimensions are dealt into ``n1`` first-level parts of ``n2`` second-level
parts each; by the pigeonhole principle two vectors at a distance of at most
``k`` differ in at most ``ceil((k + 1) / n1) - 1`` dimensions of some first-level
part, so they agree on one of its enumerated sets of ``n2 - k2`` second-level
parts.  Each such projection is one signature; equal signatures are candidates
(an equi-join), verified by edit distance.  No near pair is missed.

Words of equal length can only differ by a replaced letter (distance two), words
of neighbouring lengths only by one letter more (distance one), so the two cases
have their own signatures, which carry the length.  A signature that more than
``refine_above`` words share is not compared pair by pair: inside it words meet
on the word without its i-th letter instead, which only near words share.

Every join of tables that grow with the vocabulary is a sort-merge join: a small
file may hold many words, and a broadcast would gather them in the driver.

Defined cases: null and empty texts have no words; a null document id counts as
an empty text in the checksum; repeated rows count again; an empty table gives no
words; columns other than the two named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, materialize

RUN = re.compile("[a-zÀ-ÿ]+")  # after lower-casing A-Z
MIN_LENGTH = 6
MIN_COUNT = 5
DELETE_EVERY = 199
FORM_RATIO = 5

# Second-level parts for a distance of two and of one (one first-level part).
PARTS = {2: (1, 6), 1: (1, 4)}
REFINE_ABOVE = 32

# Distinct words a worker holds before it hands on its counts.
FLUSH_WORDS = 200_000


def _misspelt(run: str, crc: int) -> str:
    """The run, without one letter when the checksum says so."""
    h = zlib.crc32(run.encode(), crc)
    if h % DELETE_EVERY:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


class _CountWords:
    def __init__(self, min_length: int):
        self.min_length = min_length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))):
                self._add(total, doc, text.as_py())
                if len(total) > FLUSH_WORDS:
                    yield self._out(total)
                    total = Counter()
        if total:
            yield self._out(total)

    def _add(self, total: Counter, doc, text: str | None) -> None:
        start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
        for run, n in Counter(RUN.findall(text or "")).items():
            if len(run) >= self.min_length:
                word = _misspelt(run, start)
                if len(word) >= self.min_length:
                    total[word] += n

    @staticmethod
    def _out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts with at least ``min_length`` letters and ``min_count`` occurrences."""
    bound_batches(docs.sparkSession)
    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _CountWords(min_length), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------------------
# PartEnum
# ---------------------------------------------------------------------------

def signature_sets(k: int, n1: int, n2: int) -> list[tuple[int, ...]]:
    """The second-level parts (numbered through all first-level parts) that each signature projects on."""
    if n1 * n2 <= k + 1:
        raise ValueError("n1 * n2 must be above k + 1")
    k2 = -(-(k + 1) // n1) - 1
    return [tuple(first * n2 + p for p in kept) for first in range(n1) for kept in combinations(range(n2), n2 - k2)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so sums of element codes spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Vectors:
    """Per word, the sum of its elements' codes in each part: equal sums stand for equal projections."""

    def __init__(self, n_parts: int):
        self.n_parts, self.known = n_parts, {}

    def _element(self, letter: str, nth: int) -> tuple[int, int]:
        code = int(_mix(np.array([ord(letter) * 4096 + nth], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0])
        return (ord(letter) + nth) % self.n_parts, code

    def sums(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n_parts), np.uint64)
        for row, word in enumerate(words):
            sums = [0] * self.n_parts
            for letter, n in Counter(word).items():
                for nth in range(n):
                    found = self.known.get((letter, nth))
                    if found is None:
                        found = self._element(letter, nth)
                        if len(self.known) < 100_000:
                            self.known[letter, nth] = found
                    sums[found[0]] += found[1]
            out[row] = [s & 0xFFFFFFFFFFFFFFFF for s in sums]
        return out


SAME, SHORTER, LONGER = 0, 1, 2  # the side of a word in the join of a signature


def word_signatures(words: list[str], parts: dict[int, tuple[int, int]] = PARTS) -> tuple[np.ndarray, list[int]]:
    """Signatures of each word (one row per word) and the side that each column stands for."""
    lengths = np.array([len(w) for w in words], np.uint64)
    columns, sides = [], []
    for k, (n1, n2) in parts.items():
        sums = _Vectors(n1 * n2).sums(words)
        for number, kept in enumerate(signature_sets(k, n1, n2)):
            projected = sums[:, list(kept)].sum(axis=1, dtype=np.uint64)
            for side in ((SAME,) if k == 2 else (SHORTER, LONGER)):
                size = lengths - np.uint64(side == LONGER)
                tag = _mix(size * np.uint64(1 << 16) + np.uint64(k * 4096 + number))
                columns.append(_mix(projected ^ tag))
                sides.append(side)
    return np.stack(columns, axis=1).view(np.int64), sides


class _Signatures:
    def __init__(self, parts):
        self.parts = parts

    def __call__(self, batch: pa.RecordBatch) -> dict:
        words = batch.column("word").to_pylist()
        keys, sides = word_signatures(words, self.parts)
        rows = np.repeat(np.arange(len(words)), len(sides))
        return {"word": batch.column("word").take(pa.array(rows)), "n": batch.column("n").take(pa.array(rows)),
                "key": keys.ravel(), "side": np.tile(np.array(sides, np.int32), len(words))}


def _meet(rows: DataFrame) -> DataFrame:
    """Verified pairs of the rows that share a key, the smaller (or shorter) word first."""
    a = rows.where(F.col("side") != LONGER).select("key", "side", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.where(F.col("side") != SHORTER).select(F.col("key").alias("b_key"), F.col("side").alias("b_side"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    roles = ((F.col("side") == SAME) & (F.col("b_side") == SAME) & (F.col("a") < F.col("b"))) | ((F.col("side") == SHORTER) & (F.col("b_side") == LONGER))
    return a.join(b.hint("merge"), (F.col("key") == F.col("b_key")) & roles & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _without_letter(rows: DataFrame) -> DataFrame:
    """Keys for crowded signatures: the word without its i-th letter (and which, for words of one length)."""
    w = F.col("word")
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(
        i.alias("i"), F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)).alias("rest")))
    keys = (F.when(F.col("side") == SAME, F.transform(cut, lambda c: F.xxhash64(F.col("key"), c["i"], c["rest"])))
             .when(F.col("side") == LONGER, F.array_distinct(F.transform(cut, lambda c: F.xxhash64(F.col("key"), F.lit(0), c["rest"]))))
             .otherwise(F.array(F.xxhash64(F.col("key"), F.lit(0), w))))
    return rows.select("word", "n", "side", F.explode(keys).alias("key"))


def near_pairs(words: DataFrame, parts: dict[int, tuple[int, int]] = PARTS, refine_above: int = REFINE_ABOVE) -> DataFrame:
    """``(a, a_n, b, b_n)``: every unordered pair of words exactly one edit apart, once.

    ``words(word, n)`` with distinct words.
    """
    rows = map_batches(words.select("word", "n"), _Signatures(parts), "word string, n bigint, key bigint, side int")
    sized = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("sharing"), F.min("side").alias("lo"), F.max("side").alias("hi"))
                      # a signature of the lone shorter or the lone longer words joins nothing
                      .where((F.col("sharing") > 1) & ((F.col("hi") == SAME) | (F.col("lo") != F.col("hi")))).drop("lo", "hi").hint("merge"), "key")
    sized = materialize(sized, "signatures")
    few = sized.where(F.col("sharing") <= refine_above).drop("sharing")
    many = sized.where(F.col("sharing") > refine_above).drop("sharing")
    return _meet(few).unionByName(_meet(_without_letter(many))).distinct()


# ---------------------------------------------------------------------------
# Forms and roots
# ---------------------------------------------------------------------------

def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last word of each chain, by doubling the step.

    A form is more frequent than its word, so chains end; their length is the
    logarithm of the largest count.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(steps.join(further.hint("merge"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        steps = after.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """Per word its commonest near word, when that is ``ratio`` times as frequent, and the end of that chain.

    Returns ``(word, form, root, n, n_near, form_n)``.
    """
    words = materialize(count_words(docs, id_col, text_col, min_length, min_count), "words")
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                                           F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("own"),
                                     F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("own")
    near = materialize(near.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"),
                                   F.when(taken, -F.col("best.less")).alias("form_n")), "near-words")
    roots = follow(near.where(F.col("form").isNotNull()))
    return (words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
                 .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))
