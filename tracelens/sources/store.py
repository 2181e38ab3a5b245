"""Table store with committed versions.

The reference writes one row per commit into an embedded database.  Here a store is a
folder: ``<root>/<table>/<folder>`` holds Parquet written in bulk, and
``<root>/_commits/<n>.json`` lists, for version n, the folders that make up every table.
A commit is one file put in place by one atomic rename that fails when the file
exists.  So

* a reader sees the version it began with, before, during and after any write;
* what a transaction appends and merges into several tables appears at once or not at
  all: a job killed anywhere leaves folders that no version names, and nothing else;
* of two transactions that began with the same version the second finds the first one's
  commit: if they wrote overlapping keys of a table it gets ``Conflict``, else
  its merges are redone on the newer version;
* earlier versions stay readable until ``vacuum``.

Tables are partitioned by ``repo_id`` where they have one, so per-repository reads prune
partitions.  On a cluster the root is a shared folder whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import create_file, delete_path, list_names

TABLES: dict[str, T.StructType] = {
    "repository": S.REPOSITORY,
    "git_file": S.GIT_FILE,
    "issue": S.ISSUE,
    "pull_request": S.PULL_REQUEST,
    "comment": S.COMMENT,
    "modified_file": S.MODIFIED_FILE,
    "result": S.RESULT,
    "feature": S.FEATURE,
    "manifest": S.MANIFEST,
    "scored": S.SCORED,
    "reject": S.REJECT,
}

# Natural keys of the tables that are merged into.
KEYS: dict[str, list[str]] = {
    "repository": ["repo_id"],
    "git_file": ["repo_id", "path"],
    "issue": ["repo_id", "number"],
    "pull_request": ["repo_id", "number"],
    "comment": ["comment_id"],
    "modified_file": ["repo_id", "pull_number", "path"],
    "manifest": ["repo_id", "snapshot_sha", "path"],
    "reject": ["blob_sha", "error"],
}

# Tables whose rows may be appended by several writers at once: equal content gives equal rows.
SHARED = {"feature"}


class Conflict(RuntimeError):
    """Another writer committed overlapping keys of the same table first."""


@dataclass
class Version:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)  # the folders of each table
    changed: dict[str, list] = field(default_factory=dict)      # lowest and highest key written, per table


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/_commits"


def _partitioning(name: str) -> list[str]:
    return ["repo_id"] if "repo_id" in TABLES[name].fieldNames() else []


def _range_column(name: str) -> str:
    """The column whose range stands for the keys that a transaction wrote."""
    fields = TABLES[name].fieldNames()
    return "repo_id" if "repo_id" in fields else fields[0]


# ---------------------------------------------------------------------------
# Versions
# ---------------------------------------------------------------------------

def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first (0, the empty store, is not listed)."""
    return sorted(int(n[:-5]) for n in list_names(spark, _commits(root)) if n.endswith(".json"))


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A committed version (the newest by default)."""
    known = versions(spark, root)
    number = (known[-1] if known else 0) if number is None else number
    if number == 0:
        return Version()
    if number not in known:
        raise ValueError(f"store {root} has no version {number}")
    text = spark.read.text(f"{_commits(root)}/{number:020d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def _read(spark: SparkSession, root: str, name: str, at: Version) -> DataFrame:
    folders = at.tables.get(name, [])
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    path = table_path(root, name)
    rows = spark.read.schema(TABLES[name]).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    return rows.select(*TABLES[name].fieldNames())


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A stored table with its declared schema, as of the newest or the named version."""
    return _read(spark, root, name, version(spark, root, number))


def latest(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order``, then by all columns (so retries agree)."""
    first = [F.col(c) for c in (order or [])]
    top = rows.groupBy(*key).agg(F.max(F.struct(*first, F.struct(*rows.columns).alias("__row"))).alias("__top"))
    return top.select(*[F.col(f"__top.__row.{c}").alias(c) for c in rows.columns])


# ---------------------------------------------------------------------------
# Transactions
# ---------------------------------------------------------------------------

class Transaction:
    """Writes to several tables that take effect together at ``commit``.

    ``read`` gives the version that the transaction began with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base = version(spark, root)
        self.appended: dict[str, list[str]] = {}
        self.merging: dict[str, DataFrame] = {}
        self.dropped: set[str] = set()
        self.changed: dict[str, list] = {}

    def read(self, name: str) -> DataFrame:
        return _read(self.spark, self.root, name, self.base)

    def append(self, df: DataFrame, name: str) -> None:
        """Add rows (columns aligned by name to the declared schema)."""
        self.appended.setdefault(name, []).append(self._written(df, name))

    def merge(self, df: DataFrame, name: str) -> None:
        """A12 by natural key: rows of ``df`` replace rows of the same key, so a repeated merge changes nothing.

        Written at the commit (again when it is redone), so ``df`` must give the same rows each time.
        """
        if name in self.merging:
            raise ValueError(f"{name} is merged once in a transaction")
        self.merging[name] = latest(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]), KEYS[name])

    def drop(self, name: str) -> None:
        """The table is empty from this commit on."""
        self.dropped.add(name)
        self.changed[name] = [None, None]

    def commit(self) -> int:
        """Put the writes in place; the number of the new version (the present one when nothing was written)."""
        if not (self.appended or self.merging or self.dropped):
            return self.base.number
        while True:
            tables = {n: list(f) for n, f in self.base.tables.items() if n not in self.dropped}
            for name, rows in self.merging.items():
                tables[name] = [self._rewritten(name, tables.get(name, []), rows)]
            for name, folders in self.appended.items():
                tables[name] = tables.get(name, []) + folders
            number = self.base.number + 1
            text = json.dumps({"number": number, "tables": tables, "changed": self.changed}, sort_keys=True)
            if create_file(self.spark, f"{_commits(self.root)}/{number:020d}.json", text):
                return number
            self._rebase(version(self.spark, self.root, number))

    def _rebase(self, other: Version) -> None:
        for name, theirs in other.changed.items():
            mine = self.changed.get(name)
            if mine is not None and _overlap(mine, theirs) and not (name in SHARED and name not in self.dropped and None not in theirs):
                raise Conflict(f"version {other.number} wrote keys {theirs} of {name}, this transaction {mine}")
        self.base = other

    def _folder(self) -> str:
        """A folder name that no one else has; a partition of its own, so that one scan reads many."""
        return f"write={self.base.number:020d}-{uuid.uuid4().hex}"

    def _written(self, df: DataFrame, name: str) -> str:
        """A new folder with the rows."""
        seen, rows = self._watched(df, name)
        folder = self._folder()
        write_rows(rows, f"{table_path(self.root, name)}/{folder}", name)
        self._note(name, seen)
        return folder

    def _rewritten(self, name: str, folders: list[str], rows: DataFrame) -> str:
        """A new folder with the table after the merge."""
        seen, new = self._watched(rows, name)
        if folders:
            old = _read(self.spark, self.root, name, Version(tables={name: folders}))
            new = old.join(rows.select(*KEYS[name]), KEYS[name], "left_anti").select(*new.columns).unionByName(new)
        folder = self._folder()
        write_rows(new, f"{table_path(self.root, name)}/{folder}", name)
        self._note(name, seen)
        return folder

    def _watched(self, rows: DataFrame, name: str) -> tuple[Observation, DataFrame]:
        """The rows, and their key range once they are written (no pass of its own)."""
        seen, key = Observation(), F.col(_range_column(name))
        return seen, rows.observe(seen, F.min(key).alias("low"), F.max(key).alias("high"))

    def _note(self, name: str, seen: Observation) -> None:
        try:
            found = seen.get
        except Py4JJavaError:
            found = {}  # Spark drops a plan without rows together with its metrics; an unknown range meets every other
        low, high = found.get("low"), found.get("high")
        was = self.changed.get(name)
        if low is not None:
            self.changed[name] = [low, high] if was is None or None in was else [min(was[0], low), max(was[1], high)]
        elif was is None:
            self.changed[name] = [None, None]


def _overlap(mine: list, theirs: list) -> bool:
    """Whether two key ranges meet; an unknown end (no rows, or a dropped table) meets everything."""
    if None in mine or None in theirs:
        return True
    return mine[0] <= theirs[1] and theirs[0] <= mine[1]


def write_rows(df: DataFrame, path: str, name: str) -> None:
    """Rows in the table's schema, clustered by ``repo_id``.

    The ``rebalance`` hint lets AQE group each repository's rows into few tasks (few files per
    partition) and split a repository that holds a large share of the rows.
    """
    aligned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
    parts = _partitioning(name)
    if parts:
        aligned = aligned.hint("rebalance", *parts)
    aligned.write.mode("errorifexists").partitionBy(*parts).parquet(path)


def begin(spark: SparkSession, root: str) -> Transaction:
    return Transaction(spark, root)


# ---------------------------------------------------------------------------
# One-table writes and upkeep
# ---------------------------------------------------------------------------

def create_if_missing(spark: SparkSession, root: str) -> None:
    """A10: the store exists afterwards (every table is there, empty with its schema, until written)."""
    if not versions(spark, root):
        create_file(spark, f"{_commits(root)}/{1:020d}.json", json.dumps({"number": 1, "tables": {}, "changed": {}}))


def append(df: DataFrame, root: str, name: str) -> None:
    """Append rows in a transaction of their own."""
    t = begin(df.sparkSession, root)
    t.append(df, name)
    t.commit()


def merge(spark: SparkSession, df: DataFrame, root: str, name: str) -> None:
    """A12 by natural key in a transaction of its own."""
    t = begin(spark, root)
    t.merge(df, name)
    t.commit()


def drop(spark: SparkSession, root: str, name: str) -> None:
    """Empty a table and delete its data, of earlier versions too, wherever the storage is."""
    t = begin(spark, root)
    t.drop(name)
    t.commit()
    delete_path(spark, table_path(root, name))


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Rewrite a table of many folders as one; the rows stay the same."""
    t = begin(spark, root)
    if len(t.base.tables.get(name, [])) < 2:
        return t.base.number
    whole = t.read(name)
    t.drop(name)
    t.append(whole, name)
    t.changed[name] = [None, None]
    return t.commit()


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Delete the folders that none of the last ``keep`` versions names and that began before them; their commits go too.

    Folders of running transactions that began at a kept version stay.
    """
    known = versions(spark, root)
    kept = known[-keep:]
    named = {(n, f) for v in kept for n, folders in version(spark, root, v).tables.items() for f in folders}
    gone = []
    for name in TABLES:
        for folder in list_names(spark, table_path(root, name)):
            if (name, folder) not in named and int(folder.split("=")[1].split("-")[0]) < kept[0]:
                delete_path(spark, f"{table_path(root, name)}/{folder}")
                gone.append(f"{name}/{folder}")
    for v in known[:-keep]:
        delete_path(spark, f"{_commits(root)}/{v:020d}.json")
    return gone

