"""Session construction and cluster-wide settings.

Everything in the library takes a ``SparkSession`` and never assumes local
mode.  ``build_session`` is a convenience for tests, the bench and the
driver entry; on a cluster the caller's session is used as is.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for anything the library broadcasts on its own decision.
# Callers may lower it through the session conf key below.
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
BROADCAST_LIMIT_KEY = "tracelens.broadcastLimitBytes"
# Bytes of texts that one task turns into postings or pieces (held at some 20 times their size).
TASK_BYTES = 8 * 1024 * 1024
# Rows of an Arrow batch of whole texts.
ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000
# Where a locally created checkpoint folder is recorded (only when the session
# names none; ``spark.checkpoint.dir`` itself is fixed at start-up).
LOCAL_CHECKPOINT_KEY = "tracelens.localCheckpointDir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tracelens") -> SparkSession:
    """Create (or reuse) a session with the settings the library relies on.

    AQE stays on so skewed join partitions are split at run time and small
    shuffle partitions are coalesced.  The UI is off (no server).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACELENS_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application).

    Python workers import the package when they unpickle its functions; on a
    cluster, or when Spark was started in another folder, they would not find
    it.  A job submitted with ``--py-files`` needs this no more, but it does no
    harm there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-package-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Before Python work on texts: executors get the package, and Arrow batches fewer rows.

    Whole texts are wide, so a worker should hold few of them at a time.
    """
    ship_package(spark)
    if int(spark.conf.get(ARROW_ROWS_KEY)) > rows:
        spark.conf.set(ARROW_ROWS_KEY, str(rows))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and only read here.
    Otherwise a folder already given to ``SparkContext.setCheckpointDir`` is
    used; when there is none, a local master (tests, local runs) gets a fresh
    local folder and any other master an error.  ``spark.checkpoint.dir`` cannot be changed at run time, so the
    created folder is recorded under ``LOCAL_CHECKPOINT_KEY``.
    """
    sc = spark.sparkContext
    current = (spark.conf.get("spark.checkpoint.dir", None)
               or spark.conf.get(LOCAL_CHECKPOINT_KEY, None)
               or sc.getCheckpointDir())
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tracelens-ckpt-")
        spark.conf.set(LOCAL_CHECKPOINT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers spell it (scheme and authority resolved)."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever storage holds it; nothing happens if it is not there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none when it is not there)."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place whole, by one rename that never replaces; False when it is there already."""
    fs, p = _hadoop(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    qualified = fs.makeQualified(p)
    context = jvm.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(beside), qualified, none)
        return True
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def broadcast_limit(spark: SparkSession) -> int:
    value = spark.conf.get(BROADCAST_LIMIT_KEY, None)
    return int(value) if value else DEFAULT_BROADCAST_LIMIT


def measured_bytes(df: DataFrame) -> int:
    """Size of a table if it were broadcast: rows, fixed widths and the bytes of its strings, binaries and arrays (one job)."""
    wide = [F.octet_length(F.col(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    wide += [8 * F.size(F.col(c)) for c, kind in df.dtypes if kind.startswith("array")]
    per_row = sum((F.coalesce(F.greatest(w, F.lit(0)), F.lit(0)) for w in wide), F.lit(0)) + F.lit(16 * len(df.columns) + 16)
    return int(df.agg(F.sum(per_row.cast("bigint"))).first()[0] or 0)


def repartition_by_size(df: DataFrame, keys: Sequence[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Hash-partition by ``keys`` into about one partition per ``task_bytes`` of measured rows (one job).

    What a task holds of its partition (aggregations, sorts) then does not grow with
    the input, whatever ``spark.sql.shuffle.partitions`` is.
    """
    n = -(-measured_bytes(df) // task_bytes)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the measured table is within the broadcast limit."""
    return measured_bytes(df) <= (broadcast_limit(df.sparkSession) if limit is None else limit)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage so a lost executor only recomputes from the written table,
    and gives exact sizes to later broadcast decisions.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
