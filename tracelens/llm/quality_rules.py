"""Quality rules as weak supervision.

Each rule reads a few measures of a text and votes good (1), bad (-1) or
abstains (0).  Which rules to trust is not set by hand: expectation
maximisation over the table of vote patterns estimates, for every rule, how
often it is right on good and on bad documents, and the share of good ones.
A document's posterior probability of being good replaces the usual demand
that all rules pass.

The pattern table has at most 3^rules rows whatever the corpus, so only it
reaches the driver.  Defined results: a null or empty text has no words and
fails the base test; repeated rows get equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_POSTERIOR = 0.5
# Accuracies that expectation maximisation starts from.
ON_GOOD, ON_BAD = 0.98, 0.55

_SYMBOL_RUN = re.compile(rb"([#*$%&|<>])\1\1+")
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
MEASURES = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "n_lines bigint, n_distinct bigint, n_bytes bigint, letter_bytes bigint, longest_word bigint, n_symbol_runs bigint")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    tri = (h[:-2] * a ^ (h[:-2] >> np.uint64(31))) + (h[1:-1] * b ^ (h[1:-1] >> np.uint64(29))) * a + h[2:]
    order = np.sort(tri)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(tri, twice)
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES`` after the id."""
    if not text:
        return (0,) * 11
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = data.translate(None, BLANKS)
    return (len(words), len(text) - (len(data) - len(solid)), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)), len(solid),
            len(solid.translate(None, _NOT_LETTERS)), max(map(len, words), default=0), sum(1 for _ in _SYMBOL_RUN.finditer(data)))


def _measures(batch) -> dict:
    names = [x.split()[0] for x in MEASURES.split(", ")][1:]
    rows = [measure(t) for t in batch.column(1).to_pylist()]
    return {"doc_id": batch.column(0)} | {name: [r[k] for r in rows] for k, name in enumerate(names)}


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Vote of each rule as an expression over the measures; a text without words is abstained on by the share rules."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    some = c("n_words") >= 20
    return {
        "length": _vote(c("n_words").between(80, 200_000), c("n_words") < 30),
        "word_length": _vote((c("word_chars") / words).between(3, 10), (c("word_chars") / words < 2) | (c("word_chars") / words > 20)),
        "symbols": _vote(c("n_symbols") / words <= 0.1, c("n_symbols") / words > 0.5),
        "dup_lines": _vote(some & (c("n_dup_lines") / lines <= 0.1), c("n_dup_lines") / lines > 0.3),
        "repetition": _vote(some & (c("n_repeat_words") / words <= 0.15), some & (c("n_repeat_words") / words > 0.4)),
        "letters": _vote(c("letter_bytes") / F.greatest(c("n_bytes"), F.lit(1)) >= 0.85, c("letter_bytes") / F.greatest(c("n_bytes"), F.lit(1)) < 0.72),
        "symbol_runs": _vote(c("n_symbol_runs") / words <= 0.01, c("n_symbol_runs") / words > 0.1),
        "diversity": _vote(some & (c("n_distinct") / F.sqrt(words) >= 3), some & (c("n_distinct") / F.sqrt(words) < 1.5)),
        "longest_word": _vote((c("n_words") > 0) & (c("longest_word") <= 60), c("longest_word") > 400),
    }


def fit_rules(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    Returns the share of good documents and each rule's accuracy on good and
    on bad ones.  Abstentions carry no weight.  The start and a weak prior say
    that most documents are good and that a bad one fails some rules, not all.
    """
    n_rules = patterns.shape[1]
    total = max(1.0, counts.sum())
    good, bad = patterns == 1, patterns == -1
    start = np.stack([np.full(n_rules, ON_GOOD), np.full(n_rules, ON_BAD)])
    right, share = start, 0.9
    prior = 0.002 * total + 2.0
    for _ in range(rounds):
        q = posterior(patterns, share, right[0], right[1])
        w_good, w_bad = counts * q, counts * (1 - q)
        new = np.stack([(w_good @ good + ON_GOOD * prior) / (w_good @ (good | bad) + prior),
                        (w_bad @ bad + ON_BAD * prior) / (w_bad @ (good | bad) + prior)])
        # A vote never speaks for its opposite: a rule is right on good documents at least as often as it is wrong on bad ones.
        new[0] = np.clip(new[0], 0.5, 1 - 1e-4)
        new[1] = np.clip(new[1], 1 - new[0], 1 - 1e-4)
        new_share = float(np.clip((w_good.sum() + 0.9 * prior) / (total + prior), 0.05, 0.999))
        moved = abs(new - right).max() + abs(new_share - share)
        right, share = new, new_share
        if moved < 1e-9:
            break
    return share, right[0], right[1]


def weights(share: float, on_good: np.ndarray, on_bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-odds of being good: constant, and what a good or a bad vote of each rule adds."""
    return (float(np.log(share / (1 - share))), np.log(on_good / np.clip(1 - on_bad, 1e-4, 1)),
            np.log(np.clip(1 - on_good, 1e-4, 1) / on_bad))


def posterior(patterns: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    base, plus, minus = weights(share, on_good, on_bad)
    logit = base + (patterns == 1) @ plus + (patterns == -1) @ minus
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Measures, votes, posterior and verdict of every document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    voted = rules()
    measured = materialize(map_batches(rows, _measures, MEASURES), "quality-measures").withColumn(
        "votes", F.array(*[v.cast("int") for v in voted.values()]))
    table = measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    patterns = np.array([r.votes for r in table], dtype=np.int8).reshape(len(table), len(voted))
    base, plus, minus = weights(*fit_rules(patterns, np.array([r.n for r in table], dtype=np.float64)))
    logit = F.lit(base)
    for k in range(len(voted)):
        v = F.col("votes")[k]
        logit = logit + F.when(v == 1, F.lit(float(plus[k]))).when(v == -1, F.lit(float(minus[k]))).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = measured.withColumn("posterior", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
