"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share these turns.  The tree is
laid out depth-first as one stream of tokens (code points of the formatted
text): each shared turn is emitted once, by the first conversation in
depth-first order that has it.  What a conversation adds is its *segment*: a
text, its place in the stream, the position id of its first token (the number
of tokens on the path above it, not its place), the intervals of the stream
that its tokens attend to besides earlier tokens of the segment, and the
stretches under the loss mask (assistant texts).

Depth-first order is the order of path keys (a chained hash per turn), so the
layout is a distributed sort; a summary row per partition gives each partition
its offset and the places of the turns it shares with the one before.

Defined results: null texts and roles are empty; turns are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own; rows
of a null conversation form one conversation; a conversation is one sequence
and is put together in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, materialize, to_batch

KEY = 16
OPEN, CLOSE, END_ROLE = "### ", " </turn>\n", ": "
LOSS_ROLE = "assistant"

# Control strings inside texts and roles get a backslash in front; a backslash is doubled.
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_TEXT_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
_TURN_END = re.compile(r"\\(?:\\|###|</turn>)|( </turn>\n)")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|: )|(: )")


def escape(text: str, control: re.Pattern = _TEXT_CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role, _CONTROL)}{END_ROLE}{escape(text)}{CLOSE}"


def parse_turns(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn of a formatted text; start and end bound the escaped turn text."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role_from = at + len(OPEN)
        m = next(m for m in _ROLE_END.finditer(text, role_from) if m.group(1))
        role, start = unescape(text[role_from:m.start()]), m.end()
        m = next(m for m in _TURN_END.finditer(text, start) if m.group(1))
        yield role, start, m.start()
        at = m.end()


def _groups(batches, n_key: int = 1) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows with equal first columns; input is sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:n_key] != key:
                yield key, rows
                rows = []
            key = row[:n_key]
            rows.append(row)
    if rows:
        yield key, rows


def _chunks(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield to_batch({f.name: [h[f.name] for h in held] for f in schema}, schema)
            held = []
    yield to_batch({f.name: [h[f.name] for h in held] for f in schema}, schema)


_PATHS = "conv_id bigint, path binary, lens array<bigint>, loss array<bigint>, text string"


def _paths(batches):
    """One row per conversation: chained keys, formatted lengths, the loss stretch of each turn, the text."""
    def rows():
        for (conv,), turns in _groups(batches):
            key, path, lens, loss, texts = b"", [], [], [], []
            for _, _, role, text in turns:
                formatted = format_turn(role, text)
                key = hashlib.blake2b(key + formatted.encode("utf-8", "replace"), digest_size=KEY).digest()
                head = len(formatted) - len(CLOSE) - len(escape(text))
                path.append(key)
                lens.append(len(formatted))
                loss += [head, len(formatted) - len(CLOSE)] if role == LOSS_ROLE else [0, 0]
                texts.append(formatted)
            yield {"conv_id": conv, "path": b"".join(path), "lens": lens, "loss": loss, "text": "".join(texts)}

    yield from _chunks(rows(), arrow_schema(_PATHS))


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths have in common (equal keys mean equal prefixes)."""
    lo, hi = 0, min(len(a), len(b)) // KEY
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[(mid - 1) * KEY:mid * KEY] == b[(mid - 1) * KEY:mid * KEY]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_SUMMARY = "pid bigint, first_path binary, first_lens array<bigint>, first_conv bigint, added bigint, last_path binary, last_at array<bigint>, last_conv array<bigint>"


def _summary(batches):
    """Per partition: its first path, what the others add, and where the last path's turns begin.

    ``last_at`` is relative to the end of the first conversation's own tokens; -1 marks turns of the first one.
    """
    def rows():
        for (pid,), convs in _groups(batches):
            _, first, conv, lens = convs[0]
            prev, at, owner, added = first, [-1] * len(lens), [conv] * len(lens), 0
            for _, path, conv, lens_here in convs[1:]:
                k = _shared(prev, path)
                at, owner = at[:k], owner[:k]
                for n in lens_here[k:]:
                    at.append(added)
                    owner.append(conv)
                    added += n
                prev = path
            yield {"pid": pid, "first_path": first, "first_lens": lens, "first_conv": convs[0][2], "added": added,
                   "last_path": prev, "last_at": at, "last_conv": owner}

    yield from _chunks(rows(), arrow_schema(_SUMMARY), 1)


def _offsets(summaries: list) -> dict[int, tuple[int, list[int], list]]:
    """For each partition: where its new tokens begin, and the places and owners of the turns it inherits."""
    out, base, prev, places, owners = {}, 0, b"", [], []
    for s in sorted(summaries, key=lambda s: s.first_path):
        k = _shared(prev, s.first_path)
        out[s.pid] = (base, places[:k], owners[:k])
        start, first, own = base, list(places[:k]), list(owners[:k])
        for n in s.first_lens[k:]:
            first.append(start)
            own.append(s.first_conv)
            start += n
        places = [first[i] if a < 0 else start + a for i, a in enumerate(s.last_at)]
        owners = [own[i] if a < 0 else s.last_conv[i] for i, a in enumerate(s.last_at)]
        base, prev = start + s.added, s.last_path
    return out


_LAID = "conv_id bigint, leaf binary, new_from int, start bigint, position bigint, attend array<bigint>, pieces array<bigint>"


def _merged(parts: list[tuple]) -> list[list]:
    """Joins neighbouring (owner, from, to) ranges of one owner."""
    out: list[list] = []
    for owner, a, b in parts:
        if out and out[-1][0] == owner and out[-1][2] == a:
            out[-1][2] = b
        else:
            out.append([owner, a, b])
    return out


def _layout(offsets: dict[int, tuple[int, list[int], list]]):
    def run(batches):
        def rows():
            for (pid,), convs in _groups(batches):
                base, at, owner = offsets[pid]
                at, owner = list(at), list(owner)
                prev = convs[0][1][:len(at) * KEY]
                for _, path, conv, lens in convs:
                    k = _shared(prev, path)
                    at, owner = at[:k], owner[:k]
                    start = base
                    for n in lens[k:]:
                        at.append(base)
                        owner.append(conv)
                        base += n
                    above = _merged([(0, a, a + n) for a, n in zip(at[:k], lens[:k], strict=True)])
                    pieces = _merged([(o, a, a + n) for o, a, n in zip(owner, at, lens, strict=True)])
                    yield {"conv_id": conv, "leaf": path[-KEY:], "new_from": k, "start": start, "position": sum(lens[:k]),
                           "attend": [x for _, a, b in above for x in (a, b)], "pieces": [x for p in pieces for x in p]}
                    prev = path

        yield from _chunks(rows(), arrow_schema(_LAID))

    return run


class ChatTree:
    """The laid-out tree: ``segments`` (the emitted tokens) and ``conversations`` (how each is put together)."""

    def __init__(self, segments: DataFrame, conversations: DataFrame):
        self.segments, self.conversations = segments, conversations


def build(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> ChatTree:
    """Lay out all conversations.

    ``segments``: segment_id (the conversation that adds it), start, position, attend (flat from, to), text, loss (flat from, to
    inside the text).  ``conversations``: conv_id, leaf (key of the whole path), pieces (flat segment_id, from, to in the stream).
    """
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    paths = materialize(sorted_rows.mapInArrow(_paths, _PATHS), "chat-paths")
    order = ("path", "conv_id")
    ranged = materialize(paths.select("path", "conv_id", "lens").repartitionByRange(*order)
                         .select(F.spark_partition_id().cast("bigint").alias("pid"), "path", "conv_id", "lens"), "chat-ranges")
    by_part = ranged.repartition("pid").sortWithinPartitions("pid", *order)
    # One row per partition of the sort reaches the driver, with two paths each.
    offsets = _offsets(by_part.mapInArrow(_summary, _SUMMARY).collect())
    laid = materialize(by_part.mapInArrow(_layout(offsets), _LAID), "chat-layout")
    places = laid.select(F.col("conv_id").alias("segment_id"), "new_from", "start", "position", "attend")
    own = paths.join(places, F.col("conv_id").eqNullSafe(F.col("segment_id"))).where(F.size("lens") > F.col("new_from"))
    segments = own.select("segment_id", "start", "position", "attend", "new_from", "lens", "loss", "text").mapInArrow(_segments, _SEGMENTS)
    return ChatTree(segments, laid.select("conv_id", "leaf", "pieces"))


_SEGMENTS = "segment_id bigint, start bigint, position bigint, attend array<bigint>, text string, loss array<bigint>"


def _segments(batches):
    """Cuts the turns that a conversation adds out of its text, with their loss stretches."""
    def rows():
        for batch in batches:
            for name, start, position, attend, k, lens, loss, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, spans = 0, []
                for n, a, b in zip(lens[k:], loss[2 * k::2], loss[2 * k + 1::2], strict=True):
                    if a < b:
                        spans += [at + a, at + b]
                    at += n
                yield {"segment_id": name, "start": start, "position": position, "attend": attend, "text": text[sum(lens[:k]):], "loss": spans}

    yield from _chunks(rows(), arrow_schema(_SEGMENTS))


_DIGEST = "leaf binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches):
    """Reads each path's text back from its pieces: turns, text under the loss mask, length."""
    def rows():
        for (leaf,), parts in _groups(batches):
            text, mask, size = [], [], 0
            for _, _, piece, lo, loss in parts:
                mask += [(max(a - lo, 0) + size, min(b - lo, len(piece)) + size) for a, b in zip(loss[::2], loss[1::2], strict=True)
                         if a < b and b > lo and a < lo + len(piece)]
                text.append(piece)
                size += len(piece)
            text = "".join(text)
            turns, lost = hashlib.sha256(), hashlib.sha256()
            n = chars = 0
            for role, a, b in parse_turns(text):
                n += 1
                turns.update(f"{role}\n{unescape(text[a:b])}\n".encode("utf-8", "replace"))
            for a, b in mask:
                said = unescape(text[a:b])
                chars += len(said)
                lost.update(said.encode("utf-8", "replace"))
            yield {"leaf": leaf, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                   "loss_sha256": lost.hexdigest(), "formatted_chars": len(text)}

    yield from _chunks(rows(), arrow_schema(_DIGEST))


def read_back(tree: ChatTree) -> DataFrame:
    """Per conversation: what its formatted output holds, put together again from the segments.

    Conversations with the same path are read once.
    """
    segments = materialize(tree.segments, "chat-segments").select("segment_id", "start", "text", "loss")
    convs = tree.conversations
    one = convs.groupBy("leaf").agg(F.min("pieces").alias("pieces"))
    pick = lambda k: F.element_at("pieces", 3 * F.col("n") + k)
    parts = one.select("leaf", "pieces", F.explode(F.sequence(F.lit(0), F.expr("cast(size(pieces) div 3 as int) - 1"))).alias("n")).select(
        "leaf", "n", pick(1).alias("of"), pick(2).alias("a"), pick(3).alias("b"))
    joined = parts.join(segments, F.col("of").eqNullSafe(F.col("segment_id")))
    lo = F.col("a") - F.col("start")
    read = joined.select("leaf", "n", F.expr("substring(text, cast(a - start as int) + 1, cast(b - a as int))").alias("piece"),
                         lo.cast("bigint").alias("lo"), "loss").repartition("leaf").sortWithinPartitions("leaf", "n")
    return convs.select("conv_id", "leaf").join(read.mapInArrow(_digest, _DIGEST), "leaf").drop("leaf")
