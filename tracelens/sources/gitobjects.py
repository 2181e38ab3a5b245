"""Repositories read from their object folders, without a checkout.

``read_objects`` decodes the loose objects and packs of many repositories to
``(repo_id, sha, kind, content)``; ``commits``, ``tree_entries`` and
``manifests`` turn them into the manifests every snapshot operator reads.

* Files are read with ``binaryFile`` (a pack is one row, so at most 2 GB:
  ``pack.packSizeLimit`` splits larger ones); each is decoded in its own task.
* A pack's index gives the id of every entry, so deltas know their own id and
  that of their base before they are applied.
* Delta chains are resolved in rounds, one join per depth (50 at most by the
  default of the tool that writes packs).  Depths come first, from ids alone
  and by doubling, so that each round reads only the deltas of its depth.
* Every id is checked against the content; a missing base, tree or blob is an
  error, never a lost row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, qualified_path

# Fixed values of the pack format: object kinds by number, the two delta forms, the id of the tree without entries.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA = 6
REFERENCE_DELTA = 7
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
DIR_MODE = "40000"
SUBMODULE_MODE = "160000"

BATCH_BYTES = 16 << 20

OBJECT_SCHEMA = "repo_id long, sha string, kind string, content binary"
ENTRY_SCHEMA = ("repo_id long, pack string, offset long, sha string, kind string, base_offset long, base_sha string, "
                "content binary")
INDEX_SCHEMA = "repo_id long, pack string, offset long, sha string"
TREE_SCHEMA = "repo_id long, tree string, mode string, name string, sha string"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES from rows whose last column is the large one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _map(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one input row (a dict) to output tuples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    yield from rows_of({n: c[i].as_py() for n, c in zip(batch.schema.names, columns)})
        yield from _batches(rows(), _arrow(schema))
    return df.mapInArrow(run, schema)


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


# ---------------------------------------------------------------------------
# Decoding of one file
# ---------------------------------------------------------------------------

def loose_entry(row: dict) -> Iterator[tuple]:
    """One entry per loose object file."""
    raw = zlib.decompress(row["content"])
    head, _, body = raw.partition(b"\0")
    kind = head.split(b" ")[0].decode()
    yield row["repo_id"], row["file"], 0, object_id(kind, body), kind, None, None, body


def index_entries(row: dict) -> Iterator[tuple]:
    """``(repo_id, pack, offset, sha)`` of every object listed by a pack index (version 2)."""
    data = row["content"]
    if data[:8] != b"\xfftOc\0\0\0\x02":
        raise ValueError(f"{row['file']}: not a pack index of version 2")
    n = int.from_bytes(data[8 + 255 * 4:8 + 256 * 4], "big")
    ids = 8 + 1024
    at = ids + 24 * n  # after the ids and their checksums
    small = np.frombuffer(data, ">u4", n, at).astype(np.int64)
    far = small >= 1 << 31
    if far.any():
        large = np.frombuffer(data, ">u8", int(far.sum()), at + 4 * n).astype(np.int64)
        small[far] = large[small[far] - (1 << 31)]
    pack = row["file"][:-len(".idx")]
    for i in range(n):
        yield row["repo_id"], pack, int(small[i]), data[ids + 20 * i:ids + 20 * i + 20].hex()


def pack_entries(row: dict) -> Iterator[tuple]:
    """Every entry of a pack in file order; deltas carry the offset or the id of their base."""
    data = row["content"]
    if data[:4] != b"PACK":
        raise ValueError(f"{row['file']}: not a pack")
    view, at = memoryview(data), 12
    pack = row["file"][:-len(".pack")]
    for _ in range(int.from_bytes(data[8:12], "big")):
        start = at
        byte = data[at]
        number, size, shift = byte >> 4 & 7, byte & 15, 4
        at += 1
        while byte & 128:
            byte = data[at]
            size |= (byte & 127) << shift
            shift += 7
            at += 1
        base_offset = base_sha = None
        if number == OFFSET_DELTA:
            byte = data[at]
            back = byte & 127
            at += 1
            while byte & 128:
                byte = data[at]
                back = (back + 1) << 7 | byte & 127
                at += 1
            base_offset = start - back
        elif number == REFERENCE_DELTA:
            base_sha = data[at:at + 20].hex()
            at += 20
        # Fed in pieces that grow, so an entry never costs a copy of the rest of the pack.
        inflate, parts, step = zlib.decompressobj(), [], size // 2 + 64
        while not inflate.eof:
            piece = view[at:at + step]
            if not piece:
                raise ValueError(f"{row['file']}: cut off in the entry at {start}")
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        body = b"".join(parts)
        if len(body) != size:
            raise ValueError(f"{row['file']}: the entry at {start} has {len(body)} bytes, not {size}")
        yield row["repo_id"], pack, start, None, KINDS.get(number), base_offset, base_sha, body


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if not byte & 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The content a delta makes of its base: copies from the base and inserted bytes."""
    base_size, at = _number(delta, 0)
    size, at = _number(delta, at)
    if base_size != len(base):
        raise ValueError("a delta of another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            start = length = 0
            for i in range(4):
                if op >> i & 1:
                    start |= delta[at] << 8 * i
                    at += 1
            for i in range(3):
                if op >> 4 + i & 1:
                    length |= delta[at] << 8 * i
                    at += 1
            length = length or 1 << 16
            out += base[start:start + length]
        elif op:
            out += delta[at:at + op]
            at += op
        else:
            raise ValueError("a delta with an unknown step")
    if len(out) != size:
        raise ValueError("a delta that gives another size")
    return bytes(out)


def _resolved(row: dict) -> Iterator[tuple]:
    body = apply_delta(row["base"], row["content"])
    if object_id(row["kind"], body) != row["sha"]:
        raise ValueError(f"{row['sha']}: the content has another id")
    yield row["repo_id"], row["sha"], row["kind"], body


def _tree_rows(row: dict) -> Iterator[tuple]:
    data, at = row["content"], 0
    while at < len(data):
        space = data.index(b" ", at)
        end = data.index(b"\0", space)
        yield (row["repo_id"], row["sha"], data[at:space].decode(),
               data[space + 1:end].decode("utf-8", "backslashreplace"), data[end + 1:end + 21].hex())
        at = end + 21


# ---------------------------------------------------------------------------
# Objects of repositories
# ---------------------------------------------------------------------------

def _object_files(spark: SparkSession, root: str, glob: str, repo_id: int | None) -> DataFrame:
    """``(repo_id, file, content)`` of the files below ``root`` with a name like ``glob``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root))
    prefix = qualified_path(spark, root).rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    repo = F.split(relative, "/", 2)[0].cast("long") if repo_id is None else F.lit(repo_id).cast("long")
    return files.where(F.contains(F.concat(F.lit("/"), relative), F.lit("/objects/"))).select(
        repo.alias("repo_id"), relative.alias("file"), "content")


def read_objects(spark: SparkSession, root: str, repo_id: int | None = None) -> DataFrame:
    """``(repo_id, sha, kind, content)`` of every loose and packed object, each id once.

    ``root`` is the object store of one repository (``repo_id`` given; for a
    working copy its ``.git``, as Spark doesn't list hidden folders by itself)
    or holds a bare repository per folder named by its id.  An object stored several times is read once: whole before
    delta, then by pack name.
    """
    loose = _map(_object_files(spark, root, "[0-9a-f]" * 38, repo_id), loose_entry, ENTRY_SCHEMA)
    packed = _map(_object_files(spark, root, "pack-*.pack", repo_id), pack_entries, ENTRY_SCHEMA)
    index = materialize(_map(_object_files(spark, root, "pack-*.idx", repo_id), index_entries, INDEX_SCHEMA), "pack-index")
    place = ["repo_id", "pack", "offset"]
    listed = index.select(*place, "sha")
    bases = index.select("repo_id", "pack", F.col("offset").alias("base_offset"), F.col("sha").alias("__base"))
    sha = F.when(F.col("sha").isNull(), F.raise_error(F.concat(
        F.lit("not in the index of its pack: "), "pack", F.lit(" at "), F.col("offset").cast("string")))).otherwise(F.col("sha"))
    packed = (packed.drop("sha").join(listed, place, "left")
              .join(bases, ["repo_id", "pack", "base_offset"], "left")
              .select(*place, sha.alias("sha"), "kind", F.coalesce("base_sha", "__base").alias("base_sha"),
                      F.col("base_offset").isNotNull().alias("__by_offset"), "content"))
    lost = F.when(F.col("kind").isNull() & F.col("base_sha").isNull(),
                  F.raise_error(F.concat(F.lit("no base in the index: "), "sha"))).otherwise(F.col("base_sha"))
    entries = packed.withColumn("base_sha", lost).drop("__by_offset").unionByName(loose.drop("base_offset"))
    entries = materialize(entries.withColumn("is_delta", F.col("kind").isNull()), "git-entries")

    # An object that lies in several packs is taken from one of them.
    first = entries.groupBy("repo_id", "sha").agg(F.min(F.struct("is_delta", "pack", "offset")).alias("__p"))
    chosen = materialize(first.select("repo_id", "sha", "__p.pack", "__p.offset"), "git-chosen")
    entries = entries.join(chosen, ["repo_id", "sha", "pack", "offset"], "left_semi")
    checked = F.when(F.sha1(F.concat(F.encode(F.concat("kind", F.lit(" "), F.octet_length("content").cast("string")), "UTF-8"),
                                     F.unhex(F.lit("00")), "content")) == F.col("sha"), F.col("sha")).otherwise(
        F.raise_error(F.concat(F.lit("the content has another id: "), "sha")))
    whole = entries.where(~F.col("is_delta")).select("repo_id", checked.alias("sha"), "kind", "content")
    return _resolve(materialize(whole, "git-whole"), entries.where("is_delta").select("repo_id", "sha", "base_sha", "content"))


def _resolve(whole: DataFrame, deltas: DataFrame) -> DataFrame:
    """Whole objects and the contents of all delta chains on them."""
    depths = _delta_depths(deltas.select("repo_id", "sha", "base_sha"))
    if depths is None:
        return whole
    spark = whole.sparkSession
    by_depth = materialize(deltas.join(depths, ["repo_id", "sha"]).repartition("depth", "sha").sortWithinPartitions("depth"),
                           "git-deltas")
    counts = {r["depth"]: r["n"] for r in by_depth.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, base = [whole], whole
    for depth in range(1, max(counts) + 1):
        below = base.select("repo_id", F.col("sha").alias("base_sha"), "kind", F.col("content").alias("base"))
        ready = by_depth.where(F.col("depth") == depth).join(below, ["repo_id", "base_sha"])
        base = materialize(_map(ready.select("repo_id", "sha", "kind", "base", "content"), _resolved, OBJECT_SCHEMA),
                           "git-resolved")
        found = base.count()
        if found != counts[depth]:
            raise ValueError(f"{counts[depth] - found} deltas without their base object")
        out.append(base)
    # One relation over all written rounds (their schemas are the same).
    return spark.read.schema(whole.schema).parquet(*[p for d in out for p in d.inputFiles()])


def _delta_depths(edges: DataFrame) -> DataFrame | None:
    """``(repo_id, sha, depth)``: number of deltas from each one down to a whole object.

    The distance known of each delta doubles per round, so a chain of n takes
    about log2(n) joins over ids.
    """
    known = materialize(edges.select("repo_id", "sha", F.col("base_sha").alias("down"), F.lit(1).alias("depth")), "git-depth")
    n = known.count()
    if n == 0:
        return None
    while True:
        step = known.select("repo_id", F.col("sha").alias("down"), F.col("down").alias("__down"), F.col("depth").alias("__depth"))
        joined = known.join(step, ["repo_id", "down"], "left")
        known = materialize(joined.select("repo_id", "sha", F.coalesce("__down", "down").alias("down"),
                                          (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
                                          F.col("__down").isNotNull().alias("__moved")), "git-depth")
        moved, deepest = known.agg(F.max("__moved"), F.max("depth")).first()
        known = known.drop("__moved")
        if deepest > n:
            raise ValueError("deltas that are their own base")
        if not moved:
            return known.drop("down")


def commits(objects: DataFrame) -> DataFrame:
    """``(repo_id, sha, tree, parents, committed_at, message)`` of the commit objects."""
    text = F.col("content").cast("string")
    head = F.substring_index(text, "\n\n", 1)
    return objects.where(F.col("kind") == "commit").select(
        "repo_id", "sha",
        F.regexp_extract(head, r"^tree ([0-9a-f]{40})", 1).alias("tree"),
        F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})"), 1).alias("parents"),
        F.timestamp_seconds(F.regexp_extract(head, r"(?m)^committer .* (-?[0-9]+) [-+][0-9]+$", 1).cast("long")).alias("committed_at"),
        F.substr(text, F.length(head) + 3).alias("message"))


def tree_entries(objects: DataFrame) -> DataFrame:
    """``(repo_id, tree, mode, name, sha)`` of every entry of every tree object."""
    return _map(objects.where(F.col("kind") == "tree").select("repo_id", "sha", "content"), _tree_rows, TREE_SCHEMA)


def manifests(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """``(repo_id, snapshot_sha, path, mode, blob_sha)`` of every file of the given commits.

    ``snapshots(repo_id, sha, tree)`` are rows of ``commits``.  Trees are
    descended level by level, one join per depth; submodules are not files.
    """
    entries = materialize(entries, "git-tree-entries")
    level = snapshots.select("repo_id", F.col("sha").alias("snapshot_sha"), "tree", F.lit("").alias("dir"))
    files: list[DataFrame] = []
    while True:
        below = materialize(level.join(entries, ["repo_id", "tree"], "left").select(
            "repo_id", "snapshot_sha", _present("tree").alias("tree"), F.concat("dir", "name").alias("path"), "mode", "sha"),
            "git-level")
        files.append(below.where(F.col("mode").isNotNull() & ~F.col("mode").isin(DIR_MODE, SUBMODULE_MODE)))
        level = below.where(F.col("mode") == DIR_MODE).select(
            "repo_id", "snapshot_sha", F.col("sha").alias("tree"), F.concat("path", F.lit("/")).alias("dir"))
        if level.isEmpty():
            break
    paths = [p for d in files for p in d.inputFiles()]
    found = snapshots.sparkSession.read.schema(below.schema).parquet(*paths)
    return (found.where(F.col("mode").isNotNull() & ~F.col("mode").isin(DIR_MODE, SUBMODULE_MODE))
            .select("repo_id", "snapshot_sha", "path", "mode", F.col("sha").alias("blob_sha")))


def _present(tree: str) -> Column:
    """The tree id; an error when a tree other than the empty one has no entry (its object is missing)."""
    return F.when(F.col("mode").isNull() & (F.col(tree) != EMPTY_TREE),
                  F.raise_error(F.concat(F.lit("no such tree: "), tree))).otherwise(F.col(tree))


def source_trees(objects: DataFrame, manifest: DataFrame, suffix: str = ".py") -> DataFrame:
    """A8 without a checkout: the columns of ``read_source_trees`` for the files ending in ``suffix``.

    Symbolic links have no source of their own and are left out.
    """
    wanted = manifest.where(F.endswith("path", F.lit(suffix)) & (F.col("mode") != "120000")).drop("mode")
    blobs = objects.where(F.col("kind") == "blob").select(
        "repo_id", F.col("sha").alias("blob_sha"), F.col("content"))
    there = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no such blob: "), "blob_sha"))).otherwise(F.col("content"))
    return wanted.join(blobs, ["repo_id", "blob_sha"], "left").select(
        "repo_id", "snapshot_sha", "path", "blob_sha", F.try_validate_utf8(there.cast("string")).alias("source"))
