"""Mixing sources to target weights with soft memberships (DataFrame functions only).

1. A table of labelled documents trains a Bernoulli naive Bayes classifier over
   hashed words.  Only buckets whose frequency differs significantly between
   domains take part; each document gets a posterior over the domains.
2. A document of n tokens with posterior p adds ``rate * n * p[d]`` expected
   tokens to domain d.  Projected gradient descent fits nonnegative rates whose
   expected domain totals match the targets, by least squares with a weak pull
   to rate 1.  Each step needs one sum per domain over all documents; a
   document's rate is a function of the sums so far, so it is recomputed from
   them and no state is written between steps.

The written table is a row of numbers per document; the model has a weight per
domain for every bucket that passes the test (at most BUCKETS) and is passed as
literals, looked up by hash.  Defined results: null
and empty texts have no tokens, the prior as posterior, and rate 1; null or
unlisted labels are ignored; a document with several labels counts for each; a
domain without labelled documents has prior weight only; targets need not sum
to 1; without any token, or with targets that sum to 0, every rate is 1.
"""

from __future__ import annotations

import json

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, in_sample, materialize

BUCKETS = 1 << 20
# Bound of the training sample: labelled rows, chosen by a hash of the id.
TRAIN_ROWS = 40_000
STRENGTH = 20.0
SIGNIFICANT = 6.0
TOLERANCE = 1e-3
# The fit ends where this many steps moved no share by more than a tenth of the tolerance: the targets are out of reach.
STILL = 10
MAX_STEPS = 500
# The pull towards rate 1 only chooses among rates that meet the targets: it must move the shares by less than the tolerance.
PULL = 1e-5


def words_of(text: Column) -> Column:
    """Words of a text between ASCII blanks; null has none."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\x0b\x0c", "     "), " ")
    return F.filter(words, lambda w: w != "")


def buckets_of(words: Column) -> Column:
    """Hash bucket (from 1) of each word."""
    return F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)) + 1)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
          domain_col: str = "domain") -> DataFrame:
    """Rows ``b, w0, w1, ...``: what holding bucket b adds to the log odds of each domain; bucket 0 has the constants.

    Copies of a text count once in a domain.  STRENGTH documents of the common frequencies are added to each
    domain.  A bucket is kept if in some domain its count is SIGNIFICANT standard deviations from what the
    common frequency gives.
    """
    named = (labelled.select(F.col(id_col), F.col(domain_col).alias("__domain"))
             .where(F.col(id_col).isNotNull() & F.col("__domain").isin(domains)).distinct())
    share = TRAIN_ROWS / max(1, named.count())
    # At most 2 * TRAIN_ROWS rows, so the broadcast is bounded and texts stay where they are.
    sample = materialize(named.where(in_sample("mixing", F.col(id_col), share)).limit(2 * TRAIN_ROWS), "mixing-sample")
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    single = texts.groupBy("__domain", F.xxhash64("__text").alias("__h")).agg(F.min(id_col).alias(id_col)).select(id_col, "__domain")
    single = materialize(single, "mixing-labelled")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(single), id_col).select(
        "__domain", F.array_distinct(buckets_of(words_of(F.col("__text")))).alias("__buckets"))
    # Bucket 0 stands for the document itself, so one grouped count gives both document totals and bucket counts.
    counts = (rows.select("__domain", F.explode(F.concat(F.array(F.lit(0)), "__buckets")).alias("__b"))
              .groupBy("__domain", "__b").agg(F.count(F.lit(1)).alias("__n")))
    wide = counts.groupBy("__b").pivot("__domain", domains).agg(F.first("__n"))
    wide = materialize(wide.select(F.col("__b").alias("b"), *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(f"n{k}") for k, d in enumerate(domains)]), "mixing-counts")
    ks = range(len(domains))
    n = [F.col(f"n{k}").cast("double") for k in ks]
    row = wide.where("b = 0").first()
    size = [float(row[k + 1]) if row else 0.0 for k in ks]
    total = sum(size)
    common = F.least((sum(n[1:], n[0]) + 1.0) / (total + 2.0), F.lit(0.999))
    frequency = [F.least((n[k] + STRENGTH * common) / (size[k] + STRENGTH), F.lit(0.999)) for k in ks]
    odd = F.greatest(*[F.abs(n[k] - size[k] * common) / F.sqrt(size[k] * common + 1.0) for k in ks], F.lit(0.0))
    chosen = materialize(wide.where("b > 0").withColumn("odd", odd).where(F.col("odd") >= SIGNIFICANT).select(
        "b", *[(F.log(frequency[k] / (1 - frequency[k])) - F.log(common / (1 - common))).alias(f"w{k}") for k in ks],
        *[F.log((1 - frequency[k]) / (1 - common)).alias(f"a{k}") for k in ks]), "mixing-weights")
    # Added up in sorted order, so that the sums don't depend on the partitioning.
    absent = chosen.agg(*[F.aggregate(F.array_sort(F.collect_list(f"a{k}")), F.lit(0.0), lambda x, y: x + y).alias(f"a{k}") for k in ks])
    constants = absent.select(F.lit(0).alias("b"), *[
        (F.col(f"a{k}") + float(np.log((size[k] + 1.0) / (total + len(domains))))).alias(f"w{k}") for k in ks])
    return constants.union(chosen.select("b", *[f"w{k}" for k in ks]))


def _constant(values: list, kind: str) -> Column:
    """An array literal, sent as one string (a literal of many elements takes a call to the JVM for each)."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with ``__n`` (tokens) and ``__p`` (posterior over the domains, in their order)."""
    keep = docs.columns if keep is None else keep
    fitted = model.collect()  # the constants (bucket 0) and the significant buckets
    start = next(r for r in fitted if r.b == 0)
    # Used buckets are numbered by slot: a bucket is looked up in its slot, which holds one or none as a rule.
    slots = 1 << (4 * len(fitted)).bit_length()
    chosen = sorted((r for r in fitted if r.b), key=lambda r: (r.b % slots, r.b))
    held: list[list[int]] = [[] for _ in range(slots)]
    before = [0] * slots
    for place, r in enumerate(chosen):
        if not held[r.b % slots]:
            before[r.b % slots] = place
        held[r.b % slots].append(r.b)
    held_in, placed_from = _constant(held, "array<int>"), _constant(before, "int")
    slot = lambda b: F.pmod(b, F.lit(slots)) + 1
    rows = docs.select(*[F.col(c) for c in keep], words_of(F.col(text_col)).alias("__w"))
    # Places (in the list of used buckets) of those that the text holds.
    known = F.filter(F.array_distinct(buckets_of(F.col("__w"))), lambda b: F.array_contains(F.element_at(held_in, slot(b)), b))
    places = F.transform(known, lambda b: F.element_at(placed_from, slot(b)) + F.array_position(F.element_at(held_in, slot(b)), b).cast("int"))
    rows = rows.select(*keep, F.size("__w").cast("bigint").alias("__n"), places.alias("__b"))

    def log_odds(k: int) -> Column:
        w = _constant([r[k + 1] for r in chosen], "double")
        return F.lit(float(start[k + 1])) + F.aggregate("__b", F.lit(0.0), lambda a, b: a + F.element_at(w, b))

    rows = rows.select(*keep, "__n", F.array(*[log_odds(k) for k in range(len(domains))]).alias("__l"))
    rows = rows.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("__p", F.transform("__e", lambda x: x / total)).drop("__l", "__e")


def _replayed(steps: list[list[float]], pull: float) -> Column:
    """Struct of a document's rate after the given gradient steps and of the point where the next step is taken."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not steps:
        return start
    history = _constant([{"e": [float(x) for x in s], "momentum": k / (k + 3.0)} for k, s in enumerate(steps)],
                        "struct<e: array<double>, momentum: double>")
    eta = 1.0 / (1.0 + pull)

    def move(at, step):
        slope = F.aggregate(F.zip_with("__p", step["e"], lambda p, e: p * e), F.lit(0.0), lambda a, x: a + x)
        rate = F.greatest(F.lit(0.0), at["ahead"] - eta * (slope + pull * (at["ahead"] - 1.0)))
        return F.struct(rate.alias("rate"), (rate + step["momentum"] * (rate - at["rate"])).alias("ahead"))

    return F.when(F.col("__n") > 0, F.aggregate(history, start, move)).otherwise(start)


def rate_after(steps: list[list[float]], pull: float) -> Column:
    """A document's rate after the given gradient steps (each a number per domain), starting at 1."""
    return _replayed(steps, pull)["rate"]


def fit_rates(members: DataFrame, targets: list[float], tolerance: float = TOLERANCE, pull: float = PULL,
              max_steps: int = MAX_STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """Gradient steps (with Nesterov's momentum) that bring the expected token shares to the targets.

    ``members`` has ``__n`` and ``__p`` and should be a written table.  Shares
    are of all tokens before mixing; a step is the residual of a domain over
    its share, which makes the curvature nearly the same in every direction.
    Steps go on until every share is within the tolerance of its target, or until
    the shares stand still: then nonnegative rates (with the pull towards 1) can't meet the targets, and the shares after are
    the best there are.  A fit that does neither in ``max_steps`` is an error.
    Returns the steps, and the shares before and after.
    """
    k = len(targets)
    wanted = [t / sum(targets) for t in targets] if sum(targets) > 0 else []

    def shares(history):
        at = members.select("__n", "__p", _replayed(history, pull).alias("at"))
        mass = lambda rate, d: F.sum(F.col(f"at.{rate}") * F.col("__n") * F.col("__p")[d])
        row = at.agg(F.sum(F.col("__n").cast("double")), *[mass("rate", d) for d in range(k)], *[mass("ahead", d) for d in range(k)]).first()
        return ([x / row[0] for x in row[1:k + 1]], [x / row[0] for x in row[k + 1:]]) if row[0] else (None, None)

    start = now = ahead = shares([])[0]
    history: list[list[float]] = []
    if start is None or not wanted:
        return history, [0.0] * k, [0.0] * k
    near, seen = tolerance * max(wanted), [start]
    while max(abs(a - t) for a, t in zip(now, wanted, strict=True)) > near:
        if len(seen) > STILL and all(abs(a - b) <= near / 10 for was in seen[-STILL - 1:-1] for a, b in zip(was, now, strict=True)):
            break
        if len(history) >= max_steps:
            raise RuntimeError(f"shares neither met their targets nor settled in {max_steps} steps: {now} for {wanted}")
        history.append([(a - t) / max(s, 1e-6) for a, t, s in zip(ahead, wanted, start, strict=True)])
        now, ahead = shares(history)
        seen.append(now)
    return history, start, now


def reached(domains: list[str], targets: dict[str, float], after: list[float]) -> list[dict]:
    """Per domain its wanted and reached share of tokens and the residual."""
    total = sum(targets.values())
    return [{"domain": d, "wanted": targets[d] / total, "reached": a, "residual": a - targets[d] / total} for d, a in zip(domains, after, strict=True)]


def _report(domains: list[str], targets: dict[str, float], after: list[float]) -> None:
    if not any(after):
        return  # no tokens or no targets: nothing was fitted
    missed = [r for r in reached(domains, targets, after) if abs(r["residual"]) > TOLERANCE * max(targets.values()) / sum(targets.values())]
    if missed:
        warnings.warn(f"target shares out of reach: {missed}", stacklevel=3)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain") -> DataFrame:
    """``id_col, n_tokens, domain posteriors p_<domain>, rate`` for every row of ``docs``."""
    ensure_checkpoint_dir(docs.sparkSession)
    domains = sorted(targets)
    model = train(docs, labelled, domains, id_col, text_col, domain_col)
    members = materialize(posteriors(docs, model, domains, text_col, [id_col]), "mixing-members")
    steps, _, after = fit_rates(members, [targets[d] for d in domains])
    _report(domains, targets, after)
    return members.select(F.col(id_col), F.col("__n").alias("n_tokens"),
                         *[F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], rate_after(steps, PULL).alias("rate"))


def attach_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                 domain_col: str = "domain") -> DataFrame:
    """The documents of positive rate with ``rate`` and ``copies``; other columns of these names are replaced.

    ``copies`` rounds the rate up or down by a hash of the id, so its mean is the rate.  Domain totals
    come out as ``sum(rate * tokens)``.  The documents are written once with their posteriors, so that texts are classified once.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    domains = sorted(targets)
    model = train(docs, labelled, domains, id_col, text_col, domain_col)
    keep = [c for c in docs.columns if c not in ("rate", "copies")]
    member = materialize(posteriors(docs, model, domains, text_col, keep), "mixing-members")
    steps, _, after = fit_rates(member, [targets[d] for d in domains])
    _report(domains, targets, after)
    unit = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    return (member.withColumn("rate", rate_after(steps, PULL)).where("rate > 0")
            .withColumn("copies", F.floor(F.col("rate") + unit).cast("int")).select(*keep, "rate", "copies"))
