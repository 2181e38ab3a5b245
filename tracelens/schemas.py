"""Fixed schemas of the stored tables and of the code-host exports.

Natural keys replace the reference's autoincrement ids (SURVEY 1.4):
repository ``repo_id``; issue and pull request ``(repo_id, number)``;
file ``(repo_id, path)``; comment ``comment_id``; code unit
``(blob_sha, qualname, lineno)``.  Nothing is ever inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D, TS, B = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(),
                     T.TimestampType(), T.BooleanType())


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- stored tables -----------------------------------------------------------
REPOSITORY = _s(("repo_id", L), ("full_name", S), ("description", S), ("language", S), ("stars", L))
GIT_FILE = _s(("repo_id", L), ("path", S), ("file_id", L), ("sha", S))
ISSUE = _s(("repo_id", L), ("number", L), ("issue_id", L), ("title", S), ("body", S), ("state", S),
           ("created_at", TS))
PULL_REQUEST = _s(("repo_id", L), ("number", L), ("pull_id", L), ("title", S), ("body", S),
                  ("state", S), ("sha_base", S), ("issue_number", L), ("created_at", TS),
                  ("merged_at", TS))
COMMENT = _s(("comment_id", L), ("repo_id", L), ("number", L), ("seq", I), ("body", S))
MODIFIED_FILE = _s(("repo_id", L), ("pull_number", L), ("path", S), ("status", S), ("patch", S),
                   ("additions", I), ("deletions", I), ("changes", I), ("file_id", L))
RESULT = _s(("repo_id", L), ("issue_number", L), ("rank", I), ("path", S), ("file_id", L),
            ("score", D), ("unit", S))
FEATURE = _s(("blob_sha", S), ("unit", S), ("kind", S), ("version", S),
             ("vector", T.ArrayType(T.FloatType())), ("text", S))
# Issues that were scored, with the number of files they got (0 when none shares a term).
SCORED = _s(("repo_id", L), ("issue_number", L), ("n_results", L))
# Contents that could not be read or parsed.
REJECT = _s(("blob_sha", S), ("error", S))
MANIFEST = _s(("repo_id", L), ("snapshot_sha", S), ("path", S), ("blob_sha", S))

# --- exports of the code host (JSON lines, one object per row) ---------------
REPOSITORY_EXPORT = _s(("id", L), ("full_name", S), ("description", S), ("language", S),
                       ("stargazers_count", L), ("forks", L), ("size", L),
                       ("topics", T.ArrayType(S)), ("html_url", S), ("subscribers_count", L),
                       ("private", B), ("archived", B), ("pushed_at", TS))
ISSUE_EXPORT = _s(("id", L), ("repo_id", L), ("number", L), ("title", S), ("body", S),
                  ("state", S), ("created_at", TS))
PULL_EXPORT = _s(("id", L), ("repo_id", L), ("number", L), ("title", S), ("body", S),
                 ("state", S), ("base", _s(("sha", S))), ("html_url", S), ("created_at", TS),
                 ("merged_at", TS))
REVIEW_COMMENT_EXPORT = _s(("id", L), ("repo_id", L), ("pull_number", L), ("seq", I), ("body", S))
ISSUE_COMMENT_EXPORT = _s(("id", L), ("repo_id", L), ("issue_number", L), ("seq", I), ("body", S))
PULL_FILE_EXPORT = _s(("repo_id", L), ("pull_number", L), ("filename", S), ("sha", S),
                      ("status", S), ("patch", S), ("additions", I), ("deletions", I),
                      ("changes", I))
TREE_EXPORT = _s(("repo_id", L), ("snapshot_sha", S), ("type", S), ("path", S), ("sha", S))
