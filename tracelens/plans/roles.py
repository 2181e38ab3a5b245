"""Role mapping of the driver tables onto the traceability data model.

The driver tables hold no repositories or code, so each role is played by a
table whose shape fits (SURVEY section 7.4):

* ``customer``      -> repository (c_custkey id, c_name full name,
                       c_mktsegment language, c_acctbal stars, c_nationkey size)
* ``orders``        -> issue (o_orderkey number, o_custkey repository) and,
                       with texts built from its columns, pull request
* ``conversations`` -> comments of a pull request (conv_id = pull number, turn = order)
* ``part``          -> files of a repository tree
* ``lineitem``      -> changed files of pull requests (l_orderkey pull, l_partkey file)
* ``documents``     -> source files; ``source`` names the snapshot they belong to
* ``benchmark``     -> issue texts
* ``embeddings``    -> function vectors (label = file)

Derived text columns are written once as SQL expressions and used verbatim by
both the Spark queries (``F.expr``) and the DuckDB oracle texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Pull request title and body built from an order row.  They cover the
# reference forms: '#n', full URL, upper case, colon (no match), a keyword
# inside a word ('enclose'), a newline between keyword and number, a second
# reference after a comma (not matched) and a missing body.
PR_TITLE_SQL = """CASE o_orderkey % 5
  WHEN 0 THEN 'Fixes #' || CAST(o_orderkey AS STRING) || ' and closes #' || CAST(o_orderkey + 1 AS STRING)
  WHEN 1 THEN 'Update ' || o_orderpriority
  WHEN 2 THEN 'fix: #' || CAST(o_orderkey AS STRING)
  WHEN 3 THEN 'RESOLVED https://code.example.com/acme/repo' || CAST(o_custkey AS STRING) || '/issues/' || CAST(o_orderkey + 2 AS STRING)
  ELSE 'Enclose #' || CAST(o_orderkey AS STRING) || ', #' || CAST(o_orderkey + 3 AS STRING) END"""

PR_BODY_SQL = """CASE o_orderkey % 3
  WHEN 0 THEN NULL
  WHEN 1 THEN 'This change closes  #' || CAST(o_orderkey AS STRING) || chr(10) || 'fixed' || chr(10) || '#' || CAST(o_custkey AS STRING)
  ELSE 'See #' || CAST(o_orderkey + 9 AS STRING) || ' (fixing #' || CAST(o_orderkey AS STRING) || ')' END"""

# Comment text: the whole conversation turn plus, on some turns, a reference.
COMMENT_BODY_SQL = """text || CASE turn % 3
  WHEN 1 THEN ' fixes #' || CAST(conv_id AS STRING)
  WHEN 2 THEN ' Closes https://code.example.com/acme/app/pull/' || CAST(conv_id + turn AS STRING)
  ELSE '' END"""

# Snapshot (base commit) of a pull request: one per repository and year.
PR_BASE_SHA_SQL = "sha1(CAST(o_custkey AS STRING) || '@' || CAST(year(o_orderdate) AS STRING))"


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests: ``(repo_id, number, title, body, state, created_at, merged_at, sha_base)``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("repo_id"),
        F.col("o_orderkey").alias("number"),
        F.expr(PR_TITLE_SQL).alias("title"),
        F.expr(PR_BODY_SQL).alias("body"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("merged_at"),
        F.expr(PR_BASE_SHA_SQL).alias("sha_base"),
    )


def pull_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments: ``(number, seq, body)`` keyed by pull number."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("number"), F.col("turn").alias("seq"),
                    F.expr(COMMENT_BODY_SQL).alias("body"))


ISSUE_TITLE_SQL = "'Issue ' || CAST(o_orderkey AS STRING)"
ISSUE_BODY_SQL = "CASE WHEN o_orderkey % 4 <> 0 THEN 'Priority ' || o_orderpriority END"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues: ``(repo_id, number, title, body, state, created_at)``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("repo_id"),
        F.col("o_orderkey").alias("number"),
        F.expr(ISSUE_TITLE_SQL).alias("title"),
        F.expr(ISSUE_BODY_SQL).alias("body"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("created_at"),
    )


# Repository columns derived from a customer row (shared with the oracle).
REPO_COLS_SQL = {
    "repo_id": "c_custkey",
    "full_name": "'acme/' || c_name",
    "description": "'Segment ' || c_mktsegment",
    "language": "c_mktsegment",
    "stars": "CAST(floor(c_acctbal) AS BIGINT)",
    "size": "CAST(c_nationkey AS BIGINT) * 1000",
    "forks": "CAST(floor(abs(c_acctbal) / 10) AS BIGINT)",
    "subscribers": "CAST(c_nationkey AS BIGINT) + 1",
    "private": "false",
    "archived": "c_acctbal < 0",
    "url": "'https://code.example.com/acme/' || c_name",
}


def repositories(spark: SparkSession, sf_dir: str, with_pushed_at: bool = False) -> DataFrame:
    """Repositories with the searchable attributes of the reference's exports.

    ``pushed_at`` (latest activity) is the newest order date of the customer,
    a grouped aggregate joined on demand.
    """
    c = table(spark, sf_dir, "customer")
    repos = c.select(*[F.expr(e).alias(n) for n, e in REPO_COLS_SQL.items()],
                     F.array(F.lower("c_mktsegment"),
                             F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
                             ).alias("topics"))
    if with_pushed_at:
        pushed = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo_id"))
                  .agg(F.max("o_orderdate").alias("pushed_at")))
        repos = repos.join(pushed, "repo_id", "left")
    return repos


def repos_cte_sql(with_pushed_at: bool = False) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in REPO_COLS_SQL.items())
    cols += ", [lower(c_mktsegment), 'nation-' || CAST(c_nationkey AS STRING)] AS topics"
    if with_pushed_at:
        cols += ", (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS pushed_at"
    return f"repos AS (SELECT {cols} FROM customer)"


# Files of a repository tree and changed files of pull requests.
FILE_PATH_SQL = "p_brand || '/' || replace(p_name, ' ', '_') || '.py'"
