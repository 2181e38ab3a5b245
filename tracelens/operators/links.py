"""Pull request -> issue links.

The reference reads each pull request's title, body and review comments,
extracts closing references and keeps one issue number per pull request:
the first title reference, else the first body reference, else the first
reference found in the comments taken in order.  Here that is a column
expression plus one grouped aggregation over the comments and one left join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import closing_refs, first_ref


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def comment_refs(comments: DataFrame, key: Sequence[str] | str, order: str = "seq",
                 text: str = "body") -> DataFrame:
    """Every reference of every comment, flat: ``(key..., order, pos, ref)``.

    Kept as rows (not one array per pull request) so a pull request with a
    huge comment thread never becomes one unbounded value.
    """
    k = _cols(key)
    return (comments.select(*k, order, F.posexplode(closing_refs(text)).alias("pos", "ref"))
                    .where(F.col("ref").isNotNull()))


def first_comment_ref(comments: DataFrame, key: Sequence[str] | str, order: str = "seq",
                      text: str = "body") -> DataFrame:
    """D3: first reference over a pull request's comments in comment order.

    ``min_by`` aggregates partially on the map side, so a pull request with a
    very long thread does not land in one task.
    """
    k = _cols(key)
    return (comment_refs(comments, k, order, text)
            .groupBy(*k)
            .agg(F.min_by("ref", F.struct(F.col(order), F.col("pos"))).alias("comment_link"),
                 F.count(F.lit(1)).alias("n_comment_links")))


def pull_links(pulls: DataFrame, key: Sequence[str] | str, comments: DataFrame | None = None,
               title: str = "title", body: str = "body", comment_order: str = "seq",
               comment_text: str = "body") -> DataFrame:
    """H2: ``pulls`` plus ``link`` (issue number or NULL) and ``link_source``.

    A NULL body has no references (the reference reused the previous pull
    request's value there; see SURVEY Q2).
    """
    k = _cols(key)
    out = (pulls.withColumn("title_link", first_ref(title))
                .withColumn("body_link", first_ref(body)))
    if comments is not None:
        firsts = first_comment_ref(comments, k, comment_order, comment_text)
        out = out.join(firsts.select(*k, "comment_link"), k, "left")
    else:
        out = out.withColumn("comment_link", F.lit(None).cast("bigint"))
    return (out.withColumn("link", F.coalesce("title_link", "body_link", "comment_link"))
               .withColumn("link_source",
                           F.when(F.col("title_link").isNotNull(), "title")
                            .when(F.col("body_link").isNotNull(), "body")
                            .when(F.col("comment_link").isNotNull(), "comment"))
               .drop("title_link", "body_link", "comment_link"))


def resolve_links(linked_pulls: DataFrame, issues: DataFrame, repo: str = "repo_id",
                  link: str = "link", issue_number: str = "number",
                  issue_cols: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pull request -> issue by ``(repo, number)``.

    ``how="inner"`` keeps resolvable pull requests (B8 drops the others) and
    adds ``issue_number`` plus ``issue_<c>`` for each of ``issue_cols``;
    ``how="left_anti"`` returns the pull requests whose issue does not exist.
    """
    iss = issues.select(F.col(repo).alias("__irepo"), F.col(issue_number).alias("issue_number"),
                        *[F.col(c).alias(f"issue_{c}") for c in issue_cols])
    cond = (F.col(repo) == F.col("__irepo")) & (F.col(link) == F.col("issue_number"))
    joined = linked_pulls.where(F.col(link).isNotNull()).join(iss, cond, how)
    if how in ("left_anti", "left_semi"):
        return joined
    return joined.drop("__irepo")


def merged_and_linked(pulls: DataFrame, merged: str = "merged_at", link: str = "link") -> DataFrame:
    """Merged pull requests that carry a closing reference."""
    return pulls.where(F.col(merged).isNotNull() & F.col(link).isNotNull())


def in_creation_order(pulls: DataFrame, created: str = "created_at",
                      number: str = "number") -> DataFrame:
    """pull requests oldest first (``sort:created-asc``), ties by number.

    A global sort: Spark range-partitions on the sort key, so it scales with
    the data and needs no single task to hold all rows.
    """
    return pulls.orderBy(F.col(created).asc_nulls_last(), F.col(number).asc())


def first_pull_per_issue(resolved: DataFrame, issue_key: Sequence[str] | str,
                         order: Sequence[str] | str, pull: str) -> DataFrame:
    """The first pull request (by ``order``) reaching each issue.

    An aggregation (``min_by`` on an ordering struct) rather than a window, so
    an issue that many pull requests reference is reduced map-side.
    """
    ik = _cols(issue_key)
    key = F.struct(*[F.col(c) for c in _cols(order)], F.col(pull).alias("__p"))
    return (resolved.groupBy(*ik)
                    .agg(F.min_by(pull, key).alias(f"first_{pull}"),
                         F.count(F.lit(1)).alias("n_pulls")))


def update_links(old: DataFrame, new: DataFrame, key: Sequence[str] | str,
                 value: str = "issue_number") -> DataFrame:
    """K5: ``old`` with ``value`` replaced where ``new`` has one (coalesce(new, old))."""
    k = _cols(key)
    n = new.select(*k, F.col(value).alias("__new"))
    return (old.join(n, k, "left")
               .withColumn(value, F.coalesce(F.col("__new"), F.col(value)))
               .drop("__new"))
