"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Index.  Every vector gets one long hash string per tree: the signs of its inner
products with random directions.  A tree is the array of all (string, vector)
pairs in string order, cut at quantiles into parts of bounded size; a prefix of a
string is a run of neighbouring rows, so no tree of nodes is stored.  Strings end
in random salt bits, so rows with equal strings can be cut apart too.

Inner products.  Vectors are grouped in bands by length (each within a factor of
two of the band's bound M) and lengthened by one coordinate ``sqrt(M^2 - |x|^2)``,
the query by 0, so within a band larger inner products are smaller angles.

Search.
1. Descent: in every tree a query goes to the part that holds its own string and
   takes the rows there with the longest common prefixes (at least
   ``descend_rows`` of them).  They are scored exactly.
2. Synchronous ascent: a row at angle t shares x signs with probability
   ``(1 - t/pi)^x``, so the share of the best rows found so far that L trees
   catch at depth x is known.  All trees of a query go up together to the
   largest depth at which that expected recall is reached, and all rows below
   that depth are scored.  The best found so far are a lower bound of the true
   ones, so the depth errs on the side of more candidates.  Once all trees together would read
   as much as one whole tree, that one is read instead: then the answer is exact.

There is no cap on candidates.  Equal vectors are searched and stored once (their
``k + 1`` smallest ids can be in an answer) and handed back to all their rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as query nor as candidate; vectors of different
dimension are never compared; ties go to the smaller id; a query with fewer
candidates than ``k`` gets all of them; an empty table gives no rows; other
columns are ignored.  Ids must be distinct (rows that repeat id and vector count once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS_KEY, arrow_schema, bound_batches, materialize, to_batch

TREES = 16
HASH_BITS = 44
SALT_BITS = 19
RECALL = 0.93        # expected recall at which the ascent ends
DESCEND_ROWS = 512   # rows taken per tree on the way down
PART_ROWS = 8192
MAX_PARTS = 1 << 16  # per tree; above, parts grow, so that the table of cuts stays under 10 MB
PART_BYTES = 1 << 22
PACK_QUERIES = 2048
BANDS = 8            # the last one holds all vectors shorter than M / 2^7
SEED = 20


# ---------------------------------------------------------------------------
# Rows to distinct vectors
# ---------------------------------------------------------------------------

def usable(vec: Column) -> Column:
    """Not null, not empty, not zero, every component finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _fingerprint(vec: Column) -> Column:
    """128 bits of a vector, equal for 0 and -0."""
    same = F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0).cast("double")).otherwise(x.cast("double")))
    return F.struct(F.xxhash64(same).alias("a"), F.xxhash64(same, F.lit(1)).alias("b"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(print, cid, dim, vec, ids, asks)`` per distinct vector: its smallest id, the ``k + 1`` smallest ids, and whether it is a query."""
    w = Window.partitionBy("print").orderBy("id")
    first = rows.dropDuplicates(["print", "id"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    asks = rows.where("ask").select("print").distinct().withColumn("asks", F.lit(True))
    return (first.groupBy("print").agg(F.min("id").alias("cid"), F.min_by("vec", "id").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))
                 .join(asks, "print", "left")
                 .select("print", "cid", F.size("vec").alias("dim"), "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))


# ---------------------------------------------------------------------------
# Hash strings
# ---------------------------------------------------------------------------

_DIRECTIONS: dict = {}


def directions(dim: int, trees: int) -> np.ndarray:
    """``dim + 1`` x ``trees * HASH_BITS`` random directions, the same in every task."""
    key = (dim, trees)
    if key not in _DIRECTIONS:
        _DIRECTIONS.clear()
        _DIRECTIONS[key] = np.random.default_rng(SEED + dim).standard_normal((dim + 1, trees * HASH_BITS))
    return _DIRECTIONS[key]


def hash_strings(vecs: np.ndarray, extra: np.ndarray, trees: int) -> np.ndarray:
    """One string of ``HASH_BITS`` signs per vector and tree, as integers (first sign highest)."""
    d = directions(vecs.shape[1], trees)
    signs = (vecs @ d[:-1] + extra[:, None] * d[-1]) > 0
    weights = np.int64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)
    return signs.reshape(len(vecs), trees, HASH_BITS) @ weights


def _band(norms: np.ndarray, longest: float) -> np.ndarray:
    return np.clip(np.floor(np.log2(longest / norms) + 1e-9), 0, BANDS - 1).astype(np.int64)


def _salt(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - 19 - 8)).astype(np.int64) & ((1 << SALT_BITS) - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


KEYS = "cid bigint, dim int, band int, tree int, key bigint, vec binary"


class _IndexRows:
    """A row per vector and tree."""

    def __init__(self, longest: dict[int, float], trees: int, kind: str):
        self.longest, self.trees, self.kind = longest, trees, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("cid bigint, dim int, band int, tree int, key bigint, vec binary")
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vecs, cids = _matrix(part.column("vec")), part.column("cid").to_numpy()
                norms = np.sqrt((vecs * vecs).sum(axis=1))
                longest = max(self.longest[int(dim)], norms.max())
                band = _band(norms, longest)
                bound = longest / 2.0 ** band
                extra = np.sqrt(np.maximum(bound * bound - norms * norms, 0))
                keys = (hash_strings(vecs, extra, self.trees) << SALT_BITS) | _salt(cids)[:, None]
                raw = vecs.astype(self.kind).tobytes()
                width = len(raw) // len(vecs)
                packed = pa.array([raw[i * width:(i + 1) * width] for i in range(len(vecs))], pa.binary())
                for tree in range(self.trees):
                    n = len(cids)
                    yield to_batch({"cid": cids, "dim": np.full(n, dim), "band": band, "tree": np.full(n, tree), "key": keys[:, tree], "vec": packed}, schema)


PART = ["dim", "band", "tree", "part"]
PACKED = "dim int, band int, tree int, part int, size int, cids binary, keys binary, vecs binary"


def _pack_part(table: pa.Table) -> pa.Table:
    """One row for a part: its rows in string order."""
    keys, cids = table.column("key").to_numpy(), table.column("cid").to_numpy()
    order = np.lexsort((cids, keys))
    vecs = table.column("vec").combine_chunks().take(pa.array(order))
    first = {c: table.column(c)[0].as_py() for c in PART}
    row = first | {"size": len(order), "cids": cids[order].tobytes(), "keys": keys[order].tobytes(), "vecs": b"".join(vecs.to_pylist())}
    return pa.Table.from_batches([to_batch({c: [v] for c, v in row.items()}, _schema(PACKED))])


def _schema(ddl: str) -> pa.Schema:
    return arrow_schema(ddl)


class Index:
    """The packed parts and where each one begins."""

    def __init__(self, parts: DataFrame, cuts: dict[tuple[int, int], list[np.ndarray]], longest: dict[int, float], trees: int, kind: str):
        self.parts, self.cuts, self.longest, self.trees, self.kind = parts, cuts, longest, trees, kind


def build_index(vectors: DataFrame, trees: int = TREES, part_rows: int = PART_ROWS, kind: str = "float64") -> Index:
    """All vectors under all trees.  ``vectors(cid, dim, vec)``, distinct; ``kind`` is the type that holds their components exactly."""
    longest = {}
    for r in vectors.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("m")).collect():
        longest[r["dim"]] = r["m"]
    bound_batches(vectors.sparkSession)
    keyed = vectors.select("cid", "dim", "vec").mapInArrow(_IndexRows(longest, trees, kind), KEYS)
    keyed = materialize(keyed, "forest-rows")
    # Cuts at quantiles, of the same strings in every band and tree.
    sizes = keyed.where("tree = 0").groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts: dict[tuple[int, int], list[np.ndarray]] = {}
    for s in sizes:
        n_parts = min(MAX_PARTS, -(-s["n"] // min(part_rows, max(64, PART_BYTES // (8 * s["dim"])))))
        if n_parts == 1:
            cuts[s["dim"], s["band"]] = [np.zeros(0, np.int64)] * trees
            continue
        shares = [i / n_parts for i in range(1, n_parts)]
        found = (keyed.where((F.col("dim") == s["dim"]) & (F.col("band") == s["band"]))
                      .groupBy("tree").agg(F.percentile_approx("key", shares, 20 * n_parts).alias("cuts")).collect())
        by_tree = {r["tree"]: np.unique(np.array(r["cuts"], np.int64)) for r in found}
        cuts[s["dim"], s["band"]] = [by_tree[t] for t in range(trees)]
    placed = keyed.mapInArrow(_Place(cuts), KEYS + ", part int")
    parts = placed.groupBy(*PART).applyInArrow(_pack_part, PACKED)
    return Index(materialize(parts, "forest"), cuts, longest, trees, kind)


class _Place:
    def __init__(self, cuts):
        self.cuts = cuts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dims, bands, trees = (batch.column(c).to_numpy() for c in ("dim", "band", "tree"))
                keys, part = batch.column("key").to_numpy(), np.zeros(batch.num_rows, np.int32)
                for dim, band, tree in np.unique(np.stack([dims, bands, trees]), axis=1).T:
                    own = (dims == dim) & (bands == band) & (trees == tree)
                    part[own] = np.searchsorted(self.cuts[dim, band][tree], keys[own], side="right")
                yield batch.append_column("part", pa.array(part, pa.int32()))


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

PROBES = "dim int, band int, tree int, part int, pack int, qid bigint, depth int, lo bigint, vec binary"


def _prefix_range(strings: np.ndarray, depth) -> tuple[np.ndarray, np.ndarray]:
    """First and last key below the prefix of ``depth`` signs."""
    rest = np.int64(HASH_BITS) - depth + SALT_BITS
    lo = (strings >> (rest - SALT_BITS)) << rest
    return lo, lo | (np.int64((1 << (HASH_BITS + SALT_BITS)) - 1) >> depth)


class _Probe:
    """Where each query looks: its own part of every tree (``depth`` -1), or all parts below its prefix."""

    def __init__(self, index: Index, packs: int):
        self.cuts, self.trees, self.packs = index.cuts, index.trees, packs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PROBES)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vecs, qids = _matrix(part.column("vec")), part.column("qid").to_numpy()
                norms = np.sqrt((vecs * vecs).sum(axis=1))
                strings = hash_strings(vecs / norms[:, None], np.zeros(len(vecs)), self.trees)
                depths = part.column("depths").to_pylist() if "depths" in part.schema.names else None
                packs, rows = _salt(qids) % self.packs, []
                for q in range(len(qids)):
                    for (d, band), cuts in self.cuts.items():
                        if d != dim:
                            continue
                        depth = -1 if depths is None else depths[q][band]
                        if depth is None or depth < -1:
                            continue
                        for tree in range(self.trees if depth != 0 else 1):
                            s = strings[q, tree]
                            if depth < 0:
                                lo = s << SALT_BITS
                                first = last = int(np.searchsorted(cuts[tree], lo, side="right"))
                            else:
                                lo, hi = _prefix_range(s, np.int64(depth))
                                first, last = (int(np.searchsorted(cuts[tree], x, side="right")) for x in (lo, hi))
                            rows += [(q, band, tree, p, depth, int(lo)) for p in range(first, last + 1)]
                    if len(rows) > 4000 or rows and q == len(qids) - 1:
                        at, band, tree, to, depth, lo = zip(*rows)
                        yield to_batch({"dim": [int(dim)] * len(rows), "band": band, "tree": tree, "part": to, "pack": packs[list(at)], "qid": qids[list(at)],
                                        "depth": depth, "lo": lo, "vec": [vecs[i].tobytes() for i in at]}, schema)
                        rows = []


PACKS = "dim int, band int, tree int, part int, qids binary, depths binary, los binary, asked binary"
FOUND = "qid bigint, band int, cid bigint, score double"


def _pack_probes(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in PART}
    row = first | {"qids": table.column("qid").to_numpy().tobytes(), "depths": table.column("depth").to_numpy().astype(np.int64).tobytes(),
                   "los": table.column("lo").to_numpy().tobytes(), "asked": b"".join(table.column("vec").to_pylist())}
    return pa.Table.from_batches([to_batch({c: [v] for c, v in row.items()}, _schema(PACKS))])


class _Score:
    """Scores a pack of queries against a part; the best ``keep`` rows of each query."""

    def __init__(self, keep: int, descend_rows: int, kind: str):
        self.keep, self.descend_rows, self.kind = keep, descend_rows, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FOUND)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                yield from self._part(row, schema)

    def _part(self, row: dict, schema: pa.Schema):
        dim = row["dim"]
        cids, keys = np.frombuffer(row["cids"], np.int64), np.frombuffer(row["keys"], np.int64)
        vecs = np.frombuffer(row["vecs"], self.kind).reshape(-1, dim).astype(np.float64)
        qids, depths, los = (np.frombuffer(row[c], np.int64) for c in ("qids", "depths", "los"))
        asked = np.frombuffer(row["asked"], np.float64).reshape(-1, dim)
        lo, hi = self._runs(keys, depths, los)
        # Queries with the same run of rows are scored in one product.
        order = np.lexsort((hi, lo))
        runs = np.flatnonzero(np.r_[True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)])
        for start, end in zip(runs, np.r_[runs[1:], len(order)]):
            a, b = lo[order[start]], hi[order[start]]
            if a >= b:
                continue
            for block in range(start, end, 256):
                yield self._best(order[block:min(end, block + 256)], a, b, qids, asked, cids, vecs, row["band"], schema)

    def _runs(self, keys: np.ndarray, depths: np.ndarray, los: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of rows of each query: below its prefix, or the longest prefixes that give enough rows."""
        lo, hi = np.zeros(len(los), np.int64), np.zeros(len(los), np.int64)
        up = depths >= 0
        for depth in np.unique(depths[up]):
            own = np.flatnonzero(up & (depths == depth))
            first, last = _prefix_range(los[own] >> SALT_BITS, np.int64(depth))
            lo[own], hi[own] = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
        todo = np.flatnonzero(~up)
        enough = min(self.descend_rows, len(keys))
        for depth in range(HASH_BITS, -1, -1):
            if not len(todo):
                break
            first, last = _prefix_range(los[todo] >> SALT_BITS, np.int64(depth))
            a, b = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            done = (b - a >= enough) | (depth == 0)
            lo[todo[done]], hi[todo[done]] = a[done], b[done]
            todo = todo[~done]
        return lo, hi

    def _best(self, qs, a, b, qids, asked, cids, vecs, band, schema) -> pa.RecordBatch:
        scores = asked[qs] @ vecs[a:b].T
        keep = min(self.keep + 3, b - a)
        near = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < b - a else np.tile(np.arange(b - a), (len(qs), 1))
        # Scored once more in one fixed order of addition, so that a pair's score never depends on its block.
        exact = (asked[qs][:, None, :] * vecs[a:b][near]).sum(axis=2)
        ids = cids[a:b][near]
        order = np.lexsort((ids, -exact), axis=1)[:, :self.keep]
        rows = np.arange(len(qs))[:, None]
        return to_batch({"qid": np.repeat(qids[qs], order.shape[1]), "band": np.full(order.size, band),
                         "cid": ids[rows, order].ravel(), "score": exact[rows, order].ravel()}, schema)


def _probe(index: Index, queries: DataFrame, n_queries: int, keep: int, descend_rows: int) -> DataFrame:
    packs = max(1, -(-n_queries // PACK_QUERIES))
    probes = queries.mapInArrow(_Probe(index, packs), PROBES)
    packed = probes.groupBy(*PART, "pack").applyInArrow(_pack_probes, PACKS)
    found = index.parts.join(packed.hint("merge"), PART).mapInArrow(_Score(keep, descend_rows, index.kind), FOUND)
    return _wide_rows(found, "forest-found")


def _wide_rows(df: DataFrame, name: str) -> DataFrame:
    """Written with few rows in a batch: a row here is a whole part."""
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS_KEY)
    conf.set(ARROW_ROWS_KEY, "4")
    try:
        return materialize(df, name)
    finally:
        conf.set(ARROW_ROWS_KEY, before)


def _keep_best(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` distinct rows per query (partial limits before the shuffle)."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")
    return found.dropDuplicates(["qid", "cid"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


class _Ascend:
    """The depth at which each query's best rows are caught with the wanted recall, per band."""

    def __init__(self, index: Index, recall: float, keep: int):
        self.longest, self.trees, self.recall, self.keep = index.longest, index.trees, recall, keep
        self.bands = sorted(index.cuts)

    def depth(self, cosines: np.ndarray) -> int:
        """The largest depth that catches rows with these cosines; 0 reads one tree whole."""
        meet = 1 - np.arccos(np.clip(cosines, -1, 1)) / np.pi
        for depth in range(HASH_BITS, 0, -1):
            if self.trees * 0.5 ** depth >= 1:
                return 0
            if (1 - (1 - meet ** depth) ** self.trees).mean() >= self.recall:
                return depth
        return 0

    def __call__(self, batch: pa.RecordBatch) -> dict:
        out = []
        for dim, vec, scores in zip(batch.column("dim").to_pylist(), batch.column("vec"), batch.column("scores").to_pylist()):
            norm = float(np.linalg.norm(np.asarray(vec.values, np.float64)))
            scores = np.array(scores or [], np.float64)
            depths = [-2] * BANDS
            for d, band in self.bands:
                if d != dim:
                    continue
                bound = self.longest[dim] / 2.0 ** band
                if len(scores) < self.keep:
                    depths[band] = 0
                elif band < BANDS - 1 and norm * bound < scores[-1]:
                    pass  # no vector of this length can come among the best
                else:
                    depths[band] = self.depth(scores / (norm * bound))
            out.append(depths)
        return {c: batch.column(c) for c in ("qid", "dim", "vec")} | {"depths": out}


class _AscendBatches(_Ascend):
    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"qid": pa.int64(), "dim": pa.int32(), "vec": pa.list_(pa.float64()), "depths": pa.list_(pa.int32())}
        schema = pa.schema([pa.field(n, t) for n, t in kinds.items()])
        for batch in batches:
            if batch.num_rows:
                yield to_batch(self(batch), schema)


def search_index(index: Index, queries: DataFrame, k: int, recall: float = RECALL, descend_rows: int = DESCEND_ROWS) -> DataFrame:
    """``(qid, cid, score, place)``: the best ``k + 1`` indexed vectors of each query.  ``queries(qid, dim, vec)``."""
    keep = k + 1
    n_queries = queries.count()
    near = _probe(index, queries, n_queries, keep, descend_rows)
    down = _keep_best(near, keep)
    best = materialize(down.groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores")), "forest-descent")
    asking = queries.join(best, "qid", "left").select("qid", "dim", "vec", "scores")
    asking = asking.mapInArrow(_AscendBatches(index, recall, keep).batches, "qid bigint, dim int, vec array<double>, depths array<int>")
    asking = materialize(asking, "forest-ascent")
    return _keep_best(near.unionByName(_probe(index, asking, n_queries, keep, descend_rows)), keep)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, recall: float = RECALL, part_rows: int = PART_ROWS, descend_rows: int = DESCEND_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest inner product found for each row where ``is_query`` holds.

    All rows are indexed and, but for the query's own, candidates.
    """
    spark = rows.sparkSession
    if int(spark.conf.get(ARROW_ROWS_KEY)) > 2000:
        spark.conf.set(ARROW_ROWS_KEY, "2000")
    kind = "float32" if dict(rows.dtypes)[vec_col] == "array<float>" else "float64"
    vec = F.col(vec_col).cast("array<double>")
    rows = (rows.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask"))
                .where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("print", _fingerprint(F.col("vec"))))
    vectors = materialize(distinct_vectors(rows, k), "vectors")
    index = build_index(vectors, trees, part_rows, kind)
    queries = vectors.where("asks").select(F.col("cid").alias("qid"), "dim", "vec")
    found = search_index(index, queries, k, recall, descend_rows)
    # From distinct vectors to rows: at most k + 1 ids of each can be in an answer.
    ids = vectors.select("cid", "ids")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "other")
    answer = (found.join(ids, "cid").select("qid", "score", F.explode("ids").alias("other"))
                   .withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
                   .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("answer")))
    asked = rows.where("ask").select("id", "print").distinct()
    prints = vectors.where("asks").select("print", F.col("cid").alias("qid"))
    mine = (asked.join(prints.join(answer, "qid"), "print")
                 .withColumn("answer", F.slice(F.filter("answer", lambda s: s["other"] != F.col("id")), 1, k)))
    return mine.select(F.col("id").alias("query_id"), F.posexplode("answer").alias("pos", "s")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.other").alias("vec_id"), F.col("s.score").alias("score"))
