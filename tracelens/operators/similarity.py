"""Scoring of code units against issue texts.

Pairwise TF-IDF cosine
----------------------
The reference fits a TF-IDF model on exactly two texts for every (file, issue)
pair (raw counts, smooth idf ``ln(3 / (1 + df)) + 1``, L2 norm).  With two
documents the idf has two values only: 1 for a term found in both texts and
``w = 1 + ln 1.5`` for a term found in one.  The cosine then has a closed form
over integer term counts ``a_t`` (issue) and ``b_t`` (unit), S = shared terms:

    score = sum_S a*b / sqrt((w2*sum_A a^2 - (w2-1)*sum_S a^2)
                             * (w2*sum_B b^2 - (w2-1)*sum_S b^2))

so no per-pair model is fitted: one equi-join of postings on
``(scope..., term)`` and one grouped sum per pair; the per-text sums of
squares travel with the postings.  Sums are integers, so scores do not depend
on partitioning.

Physical shape (what ``explain`` should show)
---------------------------------------------
* units are hash-partitioned once by their key, a partition per 8 MB of text; term counting, the per-unit
  sum of squares (a window) and the pair aggregation reuse that partitioning;
* the issue postings are broadcast when their measured size is under the
  broadcast limit, else joined by a shuffle on ``(scope, term)`` where AQE
  splits skewed (hot-term) partitions;
* top-k per issue runs as a ``WindowGroupLimit`` before its shuffle, so at most
  k rows per issue and map task cross the network.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.vectors import dot, norm
from ..session import broadcast_limit, fits_broadcast, materialize, repartition_by_size
from .joins import salted_join

# Fixed value: squared idf of a term found in only one of the two texts.
IDF_SINGLE = 1.0 + math.log(1.5)
IDF_SINGLE_SQ = IDF_SINGLE * IDF_SINGLE  # 1.9753321701094941

# Scores that one task sorts when whole groups are ranked.
ROWS_PER_RANGE = 1_000_000


def _cols(cols: Sequence[str] | str | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def term_counts(texts: DataFrame, key: Sequence[str] | str, text_col: str = "text",
                scope: Sequence[str] | str | None = None,
                partition: bool = True) -> DataFrame:
    """``(scope..., key..., term, tf)`` from whole texts.

    With ``partition`` the texts are hash-partitioned by ``key`` first, into as
    many partitions as their measured size asks for; every later aggregation
    keyed by a superset of ``key`` then runs without another shuffle (shuffling
    raw text is cheaper than shuffling postings) and in bounded memory.
    """
    key, scope = _cols(key), _cols(scope)
    ids = scope + [k for k in key if k not in scope]
    src = texts.select(*ids, F.col(text_col).alias("__text"))
    if partition:
        # Scope and key: a number that occurs in every scope is not one hot key.
        src = repartition_by_size(src, ids)
    return (src.select(*ids, F.explode(tokenize("__text")).alias("term"))
               .groupBy(*ids, "term")
               .agg(F.count(F.lit(1)).alias("tf")))


def distinct_texts(texts: DataFrame, key: Sequence[str] | str, text_col: str = "text") -> DataFrame:
    """One text per key, partitioned for ``term_counts(..., partition=False)`` (texts are shuffled once)."""
    k = _cols(key)
    return repartition_by_size(texts.select(*k, text_col), k).dropDuplicates(k)


def sum_of_squares(tf: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    """Per-text ``sum(tf^2)``."""
    return tf.groupBy(*ids).agg(F.sum(F.col("tf") * F.col("tf")).alias(name))


def tfidf_pair_scores(query_tf: DataFrame, unit_tf: DataFrame,
                      query_key: Sequence[str] | str, unit_key: Sequence[str] | str,
                      scope: Sequence[str] | str | None = None,
                      broadcast_queries: bool | None = None,
                      unit_ss: str | None = None) -> DataFrame:
    """J4/J5 (C9): TF-IDF cosine of every (query, unit) pair sharing a term.

    Inputs are ``term_counts`` outputs.  Pairs inside one scope (for instance
    ``(repo_id, snapshot_sha)``) only; pairs without a shared term score 0 and
    are not emitted.  Returns ``(scope..., query_key..., unit_key..., score)``.

    The per-text sums of squares ride along on every posting (a window over
    the text's postings, which are already partitioned by text), so the texts
    are tokenised once and no table that grows with the units is broadcast.
    ``unit_ss`` names a column of ``unit_tf`` that already holds the unit's
    sum of squares (then no window over the unit postings is needed).
    """
    qk, uk, sc = _cols(query_key), _cols(unit_key), _cols(scope)
    q_ids, u_ids = sc + [c for c in qk if c not in sc], sc + [c for c in uk if c not in sc]
    if broadcast_queries is None:
        broadcast_queries = fits_broadcast(query_tf)

    sq = F.col("tf") * F.col("tf")
    q = query_tf.select(*q_ids, "term", F.col("tf").alias("q_tf"),
                        F.sum(sq).over(Window.partitionBy(*q_ids)).alias("q_ss"))
    u_ss = F.col(unit_ss) if unit_ss else F.sum(sq).over(Window.partitionBy(*u_ids))
    u = unit_tf.select(*u_ids, "term", F.col("tf").alias("u_tf"), u_ss.alias("u_ss"))
    if broadcast_queries:
        q = F.broadcast(q)

    pair_ids = sc + [c for c in qk if c not in sc] + [c for c in uk if c not in sc]
    pairs = (u.join(q, sc + ["term"])
              .groupBy(*pair_ids)
              .agg(F.sum(F.col("q_tf") * F.col("u_tf")).alias("dot"),
                   F.sum(F.col("q_tf") * F.col("q_tf")).alias("q_shared"),
                   F.sum(F.col("u_tf") * F.col("u_tf")).alias("u_shared"),
                   F.max("q_ss").alias("q_ss"), F.max("u_ss").alias("u_ss")))
    return pairs.select(*pair_ids, tfidf_cosine(
        F.col("dot"), F.col("q_ss"), F.col("q_shared"), F.col("u_ss"), F.col("u_shared")
    ).alias("score"))


def tfidf_cosine(dot_col: Column, q_ss: Column, q_shared: Column,
                 u_ss: Column, u_shared: Column) -> Column:
    """Closed form of the two-document TF-IDF cosine (see module docstring)."""
    w2 = F.lit(IDF_SINGLE_SQ)
    qn = w2 * q_ss - (w2 - F.lit(1.0)) * q_shared
    un = w2 * u_ss - (w2 - F.lit(1.0)) * u_shared
    denom = F.sqrt(qn * un)
    return F.when(denom > 0, dot_col / denom).otherwise(F.lit(0.0))


def rank_within(scores: DataFrame, group: Sequence[str] | str, tiebreak: Sequence[str] | str,
                k: int | None = None, score_col: str = "score",
                rank_col: str = "rank") -> DataFrame:
    """Rank 1.. by score descending, ties by ``tiebreak`` ascending.

    With ``k`` only the first k per group are kept (Catalyst plans the filter
    as a partial ``WindowGroupLimit`` ahead of the shuffle, so a group sends at
    most k rows per map task).  Without ``k`` the whole ranking is needed and a
    window would hold a group in one task; ``rank_all`` spreads it instead.
    """
    if k is None:
        return rank_all(scores, group, tiebreak, score_col, rank_col)
    w = Window.partitionBy(*_cols(group)).orderBy(
        F.col(score_col).desc(), *[F.col(c).asc() for c in _cols(tiebreak)])
    return scores.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def rank_all(scores: DataFrame, group: Sequence[str] | str, tiebreak: Sequence[str] | str,
             score_col: str = "score", rank_col: str = "rank") -> DataFrame:
    """E1 over whole groups, skew-proof: the same ranks as ``row_number``.

    The scores are written once (Parquet under the shared checkpoint folder),
    so the expensive pair computation is not repeated by the range sampler or
    after a lost executor.  Rows are then range-partitioned and sorted on
    ``(group, score desc, tiebreak)``, so one large group spans many tasks;
    each row's position in its sorted partition comes from
    ``monotonically_increasing_id`` (partition id in the upper bits).  The
    positioned rows are written too, so the summary and the ranks read the
    same positions whatever the planner does with the two uses (range bounds
    are sampled per shuffle).  A summary with one row per (group, partition) gives each
    segment's first position and the number of rows of the same group in
    earlier partitions; rank = position - segment start + 1 + earlier rows.
    The summary has at most (groups + partitions) rows; it is broadcast when
    that bound, counted on the written scores, is under the broadcast limit.
    """
    g = _cols(group)
    order = [F.col(c) for c in g] + [F.col(score_col).desc()] + [F.col(c).asc() for c in _cols(tiebreak)]
    spark = scores.sparkSession
    base = materialize(scores, "scores")
    n_parts = max(spark.sparkContext.defaultParallelism, -(-base.count() // ROWS_PER_RANGE))
    ranged = materialize(base.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                             .withColumn("__pos", F.monotonically_increasing_id()), "ranked")
    ranged = ranged.withColumn("__seg", F.shiftright("__pos", 33))
    segs = ranged.groupBy(*g, "__seg").agg(F.min("__pos").alias("__start"),
                                           F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*g).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.select(*g, "__seg", "__start",
                       F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    bound = base.select(*g).distinct().count() + n_parts
    if bound * (16 * len(g) + 48) <= broadcast_limit(spark):
        segs = F.broadcast(segs)
    rank = (F.col("__pos") - F.col("__start") + F.col("__before") + 1).cast("int")
    return (ranged.join(segs, g + ["__seg"])
                  .withColumn(rank_col, rank)
                  .drop("__pos", "__seg", "__start", "__before"))


def tfidf_top_k(queries: DataFrame, units: DataFrame, query_key: str | Sequence[str],
                unit_key: str | Sequence[str], k: int, scope: Sequence[str] | None = None,
                query_text: str = "text", unit_text: str = "text",
                digits: int | None = 6) -> DataFrame:
    """J6 + F2: top-k units per query by pairwise TF-IDF cosine.

    Ties are broken by the unit key, so the result is deterministic.
    """
    qk, uk, sc = _cols(query_key), _cols(unit_key), _cols(scope)
    q_tf = term_counts(queries, qk, query_text, scope=sc)
    u_tf = term_counts(units, uk, unit_text, scope=sc)
    scores = tfidf_pair_scores(q_tf, u_tf, qk, uk, sc)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return rank_within(scores, sc + qk, uk, k)


def snapshot_top_k(query_tf: DataFrame, blob_tf: DataFrame, manifest: DataFrame,
                   scope: Sequence[str] | str, query_key: Sequence[str] | str, k: int | None,
                   path: str = "path", blob: str = "blob_sha",
                   digits: int | None = 6) -> DataFrame:
    """K4 + J5 + F2 over content ids: each query against the files of its scope.

    ``query_tf`` are the queries' postings with the scope columns;
    ``blob_tf(blob, term, tf)`` are postings per distinct content id, computed
    once however many snapshots hold the content; ``manifest(scope..., path,
    blob)`` lists the files.  Pairs are scored per (query, distinct blob of
    its scope), then mapped to paths by ``paths_top_k``.  A blob shared by
    many snapshots is tokenised once and its copies are spread by
    ``salted_join``.
    Returns ``(scope..., query_key..., path, score, rank)``.
    """
    sc = _cols(scope)
    # Per-blob sum of squares while the postings are still partitioned by
    # blob; the (scope, blob) copies then join the postings with hot blobs
    # spread over several tasks (a file kept in most snapshots).
    blob_ss = blob_tf.withColumn("__ss", F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(blob)))
    # Only terms of some query can add to a score: the others go before the postings are copied into snapshots.
    terms = materialize(query_tf.select("term").distinct(), "query-terms")
    blob_ss = blob_ss.join(F.broadcast(terms) if fits_broadcast(terms) else terms, "term", "left_semi")
    units = salted_join(manifest.select(*sc, blob).distinct(), blob_ss, blob)
    scores = tfidf_pair_scores(query_tf, units, query_key, blob, sc, unit_ss="__ss")
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return paths_top_k(scores, manifest, sc, query_key, k, path, blob)


def fill_top_k(ranked: DataFrame, queries: DataFrame, manifest: DataFrame, scope: Sequence[str] | str,
               query_key: Sequence[str] | str, k: int, path: str = "path") -> DataFrame:
    """Lists shorter than ``k`` filled with files of score 0, in path order.

    ``ranked`` is a top-k result.  A short list holds all scored files of its
    query, fewer than ``k``, so of the first ``2 k`` paths of the scope at
    least ``k`` (or all that there are) have score 0: only these are paired
    with the short queries.  A query without any scored file gets ``k`` rows.
    """
    sc, qk = _cols(scope), _cols(query_key)
    group = sc + [c for c in qk if c not in sc]
    ranked = ranked.select(*group, path, "score", "rank")
    have = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("__have"))
    short = (queries.select(*group).distinct().join(have, group, "left")
             .withColumn("__have", F.coalesce("__have", F.lit(0))).where(F.col("__have") < k))
    first = (manifest.select(*sc, path).distinct()
             .withColumn("__n", F.row_number().over(Window.partitionBy(*sc).orderBy(path))).where(F.col("__n") <= 2 * k))
    free = short.join(first.drop("__n"), sc).join(ranked.select(*group, path), group + [path], "left_anti")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(path))
    zero = (free.withColumn("__p", place).where(F.col("__have") + F.col("__p") <= k)
            .select(*group, path, F.lit(0.0).alias("score"), (F.col("__have") + F.col("__p")).cast("int").alias("rank")))
    return ranked.unionByName(zero)


def unscored_counts(scores: DataFrame, queries: DataFrame, units: DataFrame,
                    scope: Sequence[str] | str, query_key: Sequence[str] | str,
                    unit_key: Sequence[str] | str) -> DataFrame:
    """J6 zeros without emitting them: per query, units scored and units at 0.

    The reference ranks every unit, zero scores included.  Those zero-score
    pairs are all pairs of a scope that share no term; they tie at 0 and
    follow the scored units in tie-break order, so the count says everything
    about them.  Two aggregates, no pair emission: units per scope and scored
    units per query.  Returns ``(scope..., query_key..., n_scored, n_zero)``.
    """
    sc, qk, uk = _cols(scope), _cols(query_key), _cols(unit_key)
    group = sc + [c for c in qk if c not in sc]
    distinct_units = units.select(*sc, *[c for c in uk if c not in sc]).distinct()
    scored = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("n_scored"))
    q = queries.select(*group).distinct()
    if sc:
        per_scope = distinct_units.groupBy(*sc).agg(F.count(F.lit(1)).alias("__n_units"))
        out = q.join(per_scope, sc, "left")
    else:  # one scope: the unit count is a single number
        out = q.withColumn("__n_units", F.lit(distinct_units.count()))
    return (out.join(scored, group, "left")
               .select(*group, F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
                       (F.coalesce("__n_units", F.lit(0)) - F.coalesce("n_scored", F.lit(0))).alias("n_zero")))


def paths_top_k(blob_scores: DataFrame, manifest: DataFrame, scope: Sequence[str] | str,
                query_key: Sequence[str] | str, k: int | None, path: str = "path",
                blob: str = "blob_sha", carry: Sequence[str] = ()) -> DataFrame:
    """Rank the paths of each query's scope by the score of their content.

    ``blob_scores(scope..., query_key..., blob, score)``.  With ``k``, blobs
    are first cut to ``rank() <= k`` per query (ties kept): every blob has at
    least one path, so a blob with k strictly better blobs cannot place a
    path in the top k, and only about k rows per query reach the join with
    the manifest instead of every scored pair.  That cut is written once
    and broadcast after counting it, so the manifest is not shuffled.
    ``carry`` names further columns of ``blob_scores`` kept in the result.
    """
    sc, qk = _cols(scope), _cols(query_key)
    group = sc + [c for c in qk if c not in sc]
    files = manifest.select(*sc, blob, path)
    if k is not None:
        w = Window.partitionBy(*group).orderBy(F.col("score").desc())
        top = materialize(blob_scores.withColumn("__r", F.rank().over(w))
                                     .where(F.col("__r") <= k).drop("__r"), "top-blobs")
        # Written and counted: broadcast when it fits, so the manifest is
        # streamed, not shuffled.
        if fits_broadcast(top):
            top = F.broadcast(top)
        paths = files.join(top, sc + [blob])
    else:
        paths = blob_scores.join(files, sc + [blob])
    return rank_within(paths, group, path, k).select(*group, path, "score", "rank", *carry)


# ---------------------------------------------------------------------------
# Dense vectors
# ---------------------------------------------------------------------------

def cosine_scores(queries: DataFrame, units: DataFrame, scope: Sequence[str] | str,
                  query_key: Sequence[str] | str, unit_key: Sequence[str] | str,
                  query_vec: str = "vector", unit_vec: str = "vector",
                  broadcast_queries: bool | None = None) -> DataFrame:
    """J3 over C8: cosine of every unit with every query of the same scope.

    The join is an equi-join on ``scope`` (e.g. ``(repo_id, snapshot_sha)``);
    a scope is required, there is no cross join.  Norms are computed once per
    row; units whose vector is NULL are dropped (B9).
    """
    sc, qk, uk = _cols(scope), _cols(query_key), _cols(unit_key)
    if not sc:
        raise ValueError("cosine_scores needs a non-empty scope (no cross joins)")
    if broadcast_queries is None:
        broadcast_queries = fits_broadcast(queries.select(*sc, *[c for c in qk if c not in sc], query_vec))
    q = (queries.where(F.col(query_vec).isNotNull())
                .select(*sc, *[c for c in qk if c not in sc], F.col(query_vec).alias("__qv"))
                .withColumn("__qn", norm("__qv")))
    u = (units.where(F.col(unit_vec).isNotNull())
              .select(*sc, *[c for c in uk if c not in sc], F.col(unit_vec).alias("__uv"))
              .withColumn("__un", norm("__uv")))
    if broadcast_queries:
        q = F.broadcast(q)
    denom = F.col("__qn") * F.col("__un")
    return (u.join(q, sc)
             .select(*sc, *[c for c in qk if c not in sc], *[c for c in uk if c not in sc],
                     F.when(denom > 0, dot("__qv", "__uv") / denom).alias("score")))


def best_per_group(scores: DataFrame, group: Sequence[str] | str, unit: str,
                   score_col: str = "score") -> DataFrame:
    """Best score per (query, file) and the unit that reached it.

    Ties go to the smallest unit.  Partial aggregation keeps it skew-proof.
    """
    g = _cols(group)
    return (scores.groupBy(*g)
                  .agg(F.max(score_col).alias("best_score"),
                       F.min_by(unit, F.struct((-F.col(score_col)).alias("s"),
                                               F.col(unit).alias("u"))).alias(f"best_{unit}"),
                       F.count(F.lit(1)).alias("n_units")))


def centroids(vectors: DataFrame, group: Sequence[str] | str, vec_col: str = "embedding",
              out_col: str = "vector") -> DataFrame:
    """Mean vector per group, computed element-wise with partial aggregation.

    The per-group array collected at the end has the vector's dimension as
    its length, not the group's size.
    """
    g = _cols(group)
    per_dim = (vectors.select(*g, F.posexplode(vec_col).alias("pos", "x"))
                      .groupBy(*g, "pos").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return (per_dim.groupBy(*g)
                   .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("__p"))
                   .select(*g, F.transform("__p", lambda s: s["x"]).alias(out_col)))
