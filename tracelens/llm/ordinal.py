"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hash bucket of the text's distinct words (and of a few shape
marks) gives a latent quality ``z``; ordered thresholds cut it into grades:
``P(grade <= k) = sigmoid(t[k] - z)``.  The weights are shared by all grades,
so the result is an expected grade and a tail probability for selection.

The training sample is bounded and chosen by a hash of the key; texts are
hashed where they lie and only bucket numbers reach the driver.  Defined
results: null and empty texts have only shape marks; null grades are ignored; a
document with several ratings counts for each; without ratings every weight
is 0; repeated rows get equal results.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, map_batches

BITS = 18
TRAIN_ROWS = 12_000
BATCH, STEPS, MIN_DOCS = 128, 800, 10
CACHE_WORDS = 1_000_000
_SYMBOLS = b"#*$%&|<>"
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else (c | 32 if chr(c).isupper() else 32) for c in range(256))


def bucket(word: bytes) -> int:
    return (zlib.crc32(word) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)


def marks(data: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Shape marks of a text: size, repetition, share of symbols (in powers of two)."""
    n = len(words)
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return [b"\x00size%d" % min(n, 1 << 20).bit_length(), b"\x00distinct%d" % (8 * distinct // max(1, n)),
            b"\x00symbols%d" % min(8, 8 * symbols // max(1, n)), b"\x00any%d" % (n > 0)]


def text_tokens(text: str | None) -> set[bytes]:
    data = text.encode("utf-8", "replace") if text else b""
    words = data.translate(_FOLD).split()
    found = set(words)
    found.update(marks(data, words, len(found)))
    return found


class OrdinalModel:
    """Weights by bucket and increasing thresholds; ``grades`` are the rating values, in order."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, grades: list[int]):
        self.weights, self.cuts, self.grades = weights.astype(np.float32), cuts, grades
        self._cache: dict[bytes, float] = {}

    def __getstate__(self):
        return self.weights, self.cuts, self.grades

    def __setstate__(self, state):
        self.__init__(*state)

    def latent(self, text: str | None) -> float:
        cache, weights, z = self._cache, self.weights, 0.0
        if len(cache) > CACHE_WORDS:
            cache.clear()
        found = text_tokens(text)
        for w in found:
            v = cache.get(w)
            if v is None:
                v = cache[w] = float(weights[bucket(w)])
            z += v
        return z

    def tails(self, z: float) -> np.ndarray:
        """P(grade > k) for every grade but the last."""
        return 1 / (1 + np.exp(np.clip(self.cuts - z, -40, 40)))


def fit_rows(rows: list[np.ndarray], ranks: np.ndarray, grades: list[int], steps: int = STEPS, seed: int = 3,
             l2: float = 1e-3, rate: float = 0.2) -> OrdinalModel:
    """Maximum likelihood by gradient steps on batches; thresholds stay ordered by positive gaps.

    Buckets in fewer than MIN_DOCS rows get no weight.  A weight's step is divided by the root of its bucket's share
    of rows, which lets telling words move further than common ones and rare words no further than they should.
    """
    k, n = len(grades), len(rows)
    w = np.zeros(1 << BITS)
    if k < 2:
        return OrdinalModel(w, np.zeros(max(0, k - 1)), grades)
    share = np.cumsum(np.bincount(ranks, minlength=k) + 1.0)[:-1] / (n + k)
    first = np.log(share / (1 - share))
    theta = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 0.05))))
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    least = min(MIN_DOCS, max(2, n // 50))
    rows = [r[seen[r] >= least] for r in rows]
    sizes = np.array([len(r) for r in rows])
    scale = rate / np.sqrt((seen + least) / n)
    squares = np.full_like(theta, 1e-6)
    rng = np.random.default_rng(seed)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    cuts_of = lambda t: np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))
    for part in _batches(n, steps, rng):
        idx = np.concatenate([rows[i] for i in part])
        of = np.repeat(np.arange(len(part)), sizes[part])
        z = np.bincount(of, weights=w[idx], minlength=len(part))
        cuts = np.concatenate(([-np.inf], cuts_of(theta), [np.inf]))
        y = ranks[part]
        hi, lo = sig(cuts[y + 1] - z), sig(cuts[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        w -= scale * np.bincount(idx, weights=(d_hi - d_lo)[of], minlength=1 << BITS) / len(part) + rate * l2 * w
        by_cut = np.zeros(k + 1)
        np.add.at(by_cut, y + 1, -d_hi)
        np.add.at(by_cut, y, d_lo)
        slope = np.cumsum(by_cut[1:k][::-1])[::-1] / len(part) * np.concatenate(([1.0], np.exp(theta[1:])))
        squares += slope * slope
        theta -= 0.1 * slope / np.sqrt(squares)
    return OrdinalModel(w, cuts_of(theta), grades)


def _batches(n: int, steps: int, rng: np.random.Generator):
    done = 0
    while done < steps:
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            yield part
            done += 1


def _sample_tokens(batch) -> dict:
    rows = [np.unique(np.array([bucket(w) for w in text_tokens(t)], np.int32)).tobytes() for t in batch.column(1).to_pylist()]
    return {"grade": batch.column(0), "idx": rows}


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
        rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Train on about ``rows`` rated documents."""
    rated = ratings.select(F.col(id_col), F.col(grade_col).cast("int").alias("__grade")).where(
        F.col(id_col).isNotNull() & F.col("__grade").isNotNull())
    n = rated.count()
    # The limit only binds when one id is rated without end.
    picked = rated.where(in_sample("ordinal", F.col(id_col), rows / max(1, n))).limit(2 * rows)
    sample = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(picked), id_col)
    found = map_batches(sample.select("__grade", "__text"), _sample_tokens, "grade int, idx binary").limit(2 * rows).collect()
    found = sorted(found, key=lambda r: (r.grade, r.idx))
    grades = sorted({r.grade for r in found})
    ranks = np.array([grades.index(r.grade) for r in found], dtype=np.int64)
    return fit_rows([np.frombuffer(r.idx, np.int32) for r in found], ranks, grades)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
          least_grade: int | None = None, min_tail: float = 0.5) -> DataFrame:
    """``expected_grade``, ``tail_probability`` of at least ``least_grade`` (the highest by default), and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        grades = np.array(m.grades or [0], dtype=float)
        want = int(np.searchsorted(grades, grades[-1] if least_grade is None else least_grade))
        expected, tail = [], []
        for text in batch.column(1).to_pylist():
            above = m.tails(m.latent(text))
            expected.append(float(grades[0] + np.diff(grades) @ above))
            tail.append(1.0 if want == 0 else float(above[want - 1]) if want <= len(above) else 0.0)
        return {"doc_id": batch.column(0), "expected_grade": expected, "tail_probability": tail, "kept": [t >= min_tail for t in tail]}

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, expected_grade double, tail_probability double, kept boolean")
