"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every document becomes the set of its distinct five-word shingles and a
   MinHash signature.  Documents with the same set form one class, represented
   by the smallest id, so copies cost one row each from here on.
2. The forest has several trees; tree ``t`` orders the signatures by the hashes
   of tree t, t+1, ... (a rotation).  Representatives that share a first prefix
   in some tree are neighbours; neighbours of neighbours form a region.
3. A region of bounded size is one verification group.  In a larger region
   the depth adapts: some trees split it by longer prefixes until the parts are
   small enough, and every part of each of these trees is a group.  Parts that a
   whole order can't split are dealt into groups that share their first member.
4. Inside a group all pairs are compared on their full shingle sets; the group
   yields a spanning forest of its true links, never the pairs.
5. Links of split regions are joined by connected components.  What is then
   outside the largest component of its region is swept: it is compared with
   every member of the region, in groups of bounded size.  Pairs inside the
   largest component need no further link, so the result of a split region is
   that of comparing all its pairs.

Links are exact (no false link).  A true link of similarity s between different
texts is missed only if no chain of neighbours in any tree joins the two,
which has a probability of at most (1 - s^4)^16, under 1e-4 at s = 0.85.

Defined results: null texts and texts without a word have an empty set, no
links and their own id; fewer than five words make one shingle; documents with
equal ids or texts share a class; a null id is never a class's smallest id
unless all its ids are null, and keeps ``kept`` true when it is alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast
from .common import arrow_schema, bound_batches, broadcast_limit, map_batches, materialize, to_batch
from .components import connected_components

SHINGLE = 5
PERCENT = 85
TREES = 16
PER_TREE = 4
# Trees that split a large region; what they leave apart is swept.
SPLIT_TREES = 4
HASHES = TREES * PER_TREE
# Bounds of one verification group: members and shingles (8 bytes each).
GROUP_DOCS = 400
GROUP_SHINGLES = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 1_000_000

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ROLL = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j:n - k + 1 + j]) * _ROLL[j]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty set."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i:i + 4096]
        np.minimum(best, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _sketch(batch) -> dict:
    out = {"doc_id": batch.column(0), "n_shingles": [], "set_key": [], "sig": []}
    for text in batch.column(1).to_pylist():
        s = shingle_set(text)
        out["n_shingles"].append(len(s))
        out["set_key"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        out["sig"].append(signature(s).astype(">u4").tobytes() if len(s) else None)
    return out


def _prefix(tree, depth: int):
    """The first ``depth`` hashes of a signature in the order of a tree, as a key of 8 bytes."""
    doubled = F.concat(F.col("sig"), F.col("sig"))
    return F.xxhash64(F.lit(depth), doubled.substr(tree * F.lit(4 * PER_TREE) + F.lit(1), F.lit(4 * depth)))


def regions(reps: DataFrame) -> DataFrame:
    """``rep, n_shingles, sig, region`` of the representatives that have a neighbour in some tree."""
    rows = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "rep", "tree", _prefix(F.col("tree"), PER_TREE).alias("key"))
    # A bucket's members are linked to its smallest: two short rows a member, no pairs.
    least = rows.groupBy("tree", "key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = rows.join(least, ["tree", "key"]).where(F.col("rep") != F.col("first")).select("rep", "first").distinct()
    roots = connected_components(stars, "rep", "first")
    named = roots.select(F.col("id").alias("rep"), F.col("root").alias("region")).union(
        roots.select(F.col("root").alias("rep"), F.col("root").alias("region")).distinct())
    return materialize(named.join(reps, "rep"), "regions")


def split_large(members: DataFrame, group_docs: int, group_shingles: int) -> list[DataFrame]:
    """Verification groups (``rep, grp``) of the members of large regions, by adaptive depth."""
    rows = members.select("rep", "region", "n_shingles", "sig", F.explode(F.array(*[F.lit(t) for t in range(0, TREES, TREES // SPLIT_TREES)])).alias("tree"))
    parts, depth = [], PER_TREE
    while True:
        keyed = rows.withColumn("key", F.xxhash64("region", "tree", _prefix(F.col("tree"), depth)))
        count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("weight"), F.min("rep").alias("first"))
        small = (F.col("docs") <= group_docs) & (F.col("weight") <= group_shingles) | (F.col("docs") <= 2)
        state = materialize(keyed.join(count, "key").where("docs > 1"), "forest-depth")
        parts.append(state.where(small).select("rep", F.col("key").alias("grp")))
        large = state.where(~small)
        if large.isEmpty():
            return parts
        if depth >= HASHES:
            # Equal in the whole order: dealt into bounded groups, each with the smallest member.
            deals = F.greatest(F.ceil(F.col("docs") / (group_docs - 1)), F.ceil(F.col("weight") / group_shingles)).cast("bigint")
            rest = large.withColumn("deals", deals)
            own = rest.where(F.col("rep") != F.col("first")).select(
                "rep", F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("deals"))).alias("grp"))
            lead = rest.where(F.col("rep") == F.col("first")).select(
                "rep", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal")).select(
                "rep", F.xxhash64("key", "deal").alias("grp"))
            return [*parts, own, lead]
        rows = large.drop("key", "docs", "weight", "first")
        depth = min(HASHES, depth + 2)


def sweep_groups(members: DataFrame, roots: DataFrame, group_docs: int, group_shingles: int) -> DataFrame:
    """Groups that bring each member outside its region's largest component to every member.

    ``members`` has rep, region and n_shingles of split regions, ``roots`` the
    components found so far.  Members and rest are dealt by hash into blocks of
    half a group's size; a group is a block of either.
    """
    named = members.select("rep", "region", "n_shingles").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    by_root = named.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    top = by_root.groupBy("region").agg(F.sum("n").alias("docs"), F.sum("w").alias("weight"),
                                        F.max(F.struct("n", "w", "root")).alias("top"))
    half = lambda n, w: F.greatest(F.ceil(2 * n / group_docs), F.ceil(2 * w / group_shingles), F.lit(1)).cast("bigint")
    top = top.select("region", F.col("top.root").alias("main"), half(F.col("docs"), F.col("weight")).alias("blocks"),
                     half(F.col("docs") - F.col("top.n"), F.col("weight") - F.col("top.w")).alias("rests"),
                     (F.col("docs") > F.col("top.n")).alias("open"))
    named = named.join(top.where("open"), "region")
    block = lambda tag, n: F.pmod(F.xxhash64(F.lit(tag), F.col("rep")), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    all_rows = named.select("rep", "region", block("all", "blocks").alias("i"), every("rests").alias("j"))
    rest = named.where(F.col("root") != F.col("main")).select("rep", "region", block("rest", "rests").alias("j"), every("blocks").alias("i"))
    return all_rows.union(rest.select("rep", "region", "i", "j")).select("rep", F.xxhash64("region", "i", "j").alias("grp")).distinct()


def link_group(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(id, smallest id) for the members of a group that true links join to a smaller one."""
    n = len(ids)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(where, kind="stable")
    posting = owner[order]
    ends = np.cumsum(np.bincount(where, minlength=len(values)))
    begins = ends - np.bincount(where, minlength=len(values))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(n - 1):
        mine = where[offsets[i]:offsets[i + 1]]
        b, e = begins[mine], ends[mine]
        shared = e - b > 1
        b, e = b[shared], e[shared]
        common = np.zeros(n, np.int64)
        step = max(1, 2_000_000 // n)  # positions gathered at a time
        for k in range(0, len(b), step):
            width = e[k:k + step] - b[k:k + step]
            flat = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(b[k:k + step], width)
            common += np.bincount(posting[flat], minlength=n)
        linked = 100 * common >= percent * (sizes + sizes[i] - common)
        for j in np.flatnonzero(linked[i + 1:]) + i + 1:
            x, y = find(i), find(int(j))
            if x != y:
                if ids[y] < ids[x]:
                    x, y = y, x
                parent[y] = x
    return [(ids[i], ids[find(i)]) for i in range(n) if find(i) != i]


_LINKS = "id bigint, root bigint"


def _verify(percent: int):
    schema = arrow_schema(_LINKS)

    def run(batches):
        key, ids, sets = None, [], []

        def flush():
            found = link_group(ids, sets, percent) if len(ids) > 1 else []
            return to_batch({"id": [a for a, _ in found], "root": [b for _, b in found]}, schema)

        for batch in batches:
            for g, rep, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    if len(ids) > 1:
                        yield flush()
                    key, ids, sets = g, [], []
                ids.append(rep)
                sets.append(np.frombuffer(data, np.uint64))
        yield flush()

    return run


def _sets(batch) -> dict:
    return {"grp": batch.column(0), "rep": batch.column(1),
            "shingles": [shingle_set(t).tobytes() for t in batch.column(2).to_pylist()]}


def verified_links(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """True links (``id, root``) inside each group, on the full shingle sets of its members."""
    n = groups.count()
    picked = groups.withColumnRenamed("rep", "doc_id")
    if n * 24 <= broadcast_limit(rows.sparkSession):
        picked = F.broadcast(picked)
    sets = map_batches(rows.join(picked, "doc_id").select("grp", "doc_id", "text"), _sets, "grp bigint, rep bigint, shingles binary")
    dealt = sets.repartition("grp").sortWithinPartitions("grp", "rep")
    return materialize(dealt.mapInArrow(_verify(percent), _LINKS), "links")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
               group_docs: int = GROUP_DOCS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(map_batches(rows, _sketch, "doc_id bigint, n_shingles bigint, set_key binary, sig binary"), "sketches")
    classes = materialize(sketch.where("set_key is not null").groupBy("set_key")
                          .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.min("sig").alias("sig")), "classes")
    member = regions(classes.where("rep is not null").select("rep", "n_shingles", "sig"))
    size = member.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("weight"))
    large = materialize(size.where(f"docs > 2 and (docs > {group_docs} or weight > {group_shingles})").select("region"), "large-regions")
    groups = member.join(large, "region", "left_anti").select("rep", F.xxhash64("region").alias("grp"))
    links = verified_links(rows, materialize(groups, "groups"), percent)
    if not large.isEmpty():
        split = member.join(large, "region")
        parts = split_large(split, group_docs, group_shingles)
        found = verified_links(rows, materialize(reduce(DataFrame.union, parts), "groups"), percent)
        roots = connected_components(found, "id", "root")
        swept = verified_links(rows, materialize(sweep_groups(split, roots, group_docs, group_shingles), "sweep"), percent)
        links = links.union(connected_components(roots.union(swept), "id", "root"))
    roots = links.select(F.col("id").alias("rep"), "root")
    named = (classes.where("rep is not null").join(roots, "rep", "left")
             .select("set_key", F.coalesce("root", "rep").alias("root")))
    return (sketch.join(named, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return components(docs, id_col, text_col, **options).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that represent their group, same columns.

    A repeated id keeps one row of each of its texts that represents a group: its
    texts are told apart by a number of their own (above 2^62, so other documents
    represent a group first).
    """
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    again = materialize(again, "repeated-ids")
    if again.isEmpty():
        return _drop_by_id(docs, id_col, text_col, **options)
    mark, name = "_" * (1 + max(map(len, docs.columns))) + "again", "_" * (1 + max(map(len, docs.columns))) + "row"
    again = again.withColumn(mark, F.lit(True))
    text_number = F.lit(1 << 62) + F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 62))
    told = docs.join(F.broadcast(again) if fits_broadcast(again) else again, id_col, "left").withColumn(
        name, F.when(F.col(mark), text_number).otherwise(F.col(id_col).cast("bigint")))
    kept = materialize(_drop_by_id(told, name, text_col, **options), "kept-rows")
    single = kept.where(F.col(mark)).dropDuplicates([name])
    return kept.where(F.col(mark).isNull()).unionByName(single).select(*docs.columns)


def _drop_by_id(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    found = materialize(report(docs, id_col, text_col, **options).select("doc_id", "kept"), "kept-documents")
    dropped = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    small = dropped.count() * 16 <= broadcast_limit(docs.sparkSession)
    return docs.join(F.broadcast(dropped) if small else dropped, id_col, "left_anti")
