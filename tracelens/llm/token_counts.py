"""Exact token counts without token ids.

The pre-tokens counted here are runs between ASCII blanks.  For a tokenizer
whose normaliser and pre-tokenizer never join text across a blank (as with
word-level byte-pair vocabularies that drop white space) the tokens of a text
are those of its runs, so each distinct run needs to be encoded once:

1. Documents are read in blocks of bounded size.  A block numbers its distinct
   pre-tokens and keeps per document the frequencies by number.
2. The blocks' pre-tokens are exchanged by hash, packed (one row per block and
   part), so that each distinct pre-token of the corpus meets all its blocks in
   one part; there its pieces are counted once.
3. The counts return to the blocks, packed likewise, and frequencies times
   counts are summed per document.

No row is made per document and pre-token, and none of the steps has a hot key:
a pre-token occurs once per block however frequent it is.

Defined results: null and empty texts have 0 bytes and 0 tokens; special
strings inside a text count as the tokenizer's default has it; repeated rows
get equal results.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, materialize, to_batch

LIMIT = 2048
# Bound of a block: bytes of text; a longer text is a block by itself.
BLOCK_BYTES = 32_000_000
# Pre-tokens whose counts a worker remembers; beyond it some are counted again.
CACHE_TOKENS = 2_000_000

_BLOCKS = "block string, doc_id bigint, n_bytes bigint, bag binary, part int, tokens binary"


def pack(idx: np.ndarray, freq: np.ndarray) -> bytes:
    """Positions (as steps) and frequencies of one document, compressed."""
    order = np.argsort(idx)
    both = np.concatenate((np.diff(idx[order], prepend=0), freq[order])).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(bag), np.uint8)
    both = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def part_of(token: bytes, parts: int) -> int:
    return zlib.crc32(token) % parts


def _blocks(parts: int, block_bytes: int):
    """One row per document, and one per block and part with the pre-tokens of that part (a blank between two).

    A block's pre-tokens are numbered in the order of part and first sight, so the rows of its parts need no numbers.
    """
    schema = arrow_schema(_BLOCKS)

    def run(batches):
        task = TaskContext.get().partitionId()
        number, docs, vocab, size = 0, [], {}, 0

        def flush():
            name = f"{task}-{number}"
            by_part: list[list[bytes]] = [[] for _ in range(parts)]
            place = np.empty(len(vocab), np.int64)
            for w in vocab:
                by_part[part_of(w, parts)].append(w)
            at = 0
            for words in by_part:
                for w in words:
                    place[vocab[w]] = at
                    at += 1
            rows = [(name, d, n, pack(place[idx], freq), None, None) for d, n, idx, freq in docs]
            rows += [(name, None, None, None, k, zlib.compress(b" ".join(words), 1)) for k, words in enumerate(by_part) if words]
            return to_batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace") if text else b""
                found = Counter(data.split())
                idx = np.fromiter((vocab.setdefault(w, len(vocab)) for w in found), np.uint32, len(found))
                freq = np.fromiter(found.values(), np.uint32, len(found))
                docs.append((doc_id, len(data), idx, freq))
                size += len(data)
                if size >= block_bytes:
                    yield flush()
                    number, docs, vocab, size = number + 1, [], {}, 0
        if docs:
            yield flush()

    return run


class _Pieces:
    """Counts the pieces of distinct pre-tokens with a tokenizer file, loaded once per worker."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for tokens in batch.column(2).to_pylist():
                words = zlib.decompress(tokens).split()
                if len(known) > CACHE_TOKENS:
                    known.clear()
                fresh = [w for w in words if w not in known]
                for k in range(0, len(fresh), 20_000):
                    some = fresh[k:k + 20_000]
                    encoded = tokenizer.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)
                    known.update(zip(some, (len(e.ids) for e in encoded), strict=True))
                n = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                out.append(zlib.compress(n.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["of_block", "part", "pieces"])


_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _sum_block(key, docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Frequencies times piece counts for the documents of one block."""
    found = [np.ascontiguousarray(np.frombuffer(zlib.decompress(p), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
             for _, p in sorted(zip(counts.column("part").to_pylist(), counts.column("pieces").to_pylist(), strict=True))]
    pieces = np.concatenate([*found, np.zeros(1, np.int64)])
    total = []
    for bag in docs.column("bag").to_pylist():
        idx, freq = unpack(bag)
        total.append(int(pieces[idx] @ freq))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; ``tokenizer_file`` must be readable on the executors."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(parts, block_bytes), _BLOCKS), "token-blocks")
    packed = blocks.where("part is not null").select("block", "part", "tokens").repartition("part").sortWithinPartitions("part")
    counts = packed.mapInArrow(_Pieces(tokenizer_file), "of_block string, part int, pieces binary")
    documents = blocks.where("bag is not null").select("block", "doc_id", "n_bytes", "bag")
    return documents.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_sum_block, _COUNTS)


def report(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, **columns) -> DataFrame:
    return count_tokens(docs, tokenizer_file, **columns).withColumn("over_limit", F.col("n_tokens") > limit)
