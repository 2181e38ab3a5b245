"""Personal data: base patterns plus a semi-Markov conditional random field.

The base finds four kinds by fixed patterns with checks (``base_spans``).  The
field scores whole candidate segments, with features of the complete span
(shape, digit counts, checksum, neighbours), and a dynamic programme over
segments of bounded length picks boundaries and kinds together.  It is trained
on a bounded sample of text islands around digits and ``@`` whose base spans,
some of them written in looser forms, are the silver labels; its segments are
added where no base span lies and its posterior is high.

Defined results: null counts as the empty text; a text without digits and
``@`` has no spans; offsets are code points; repeated rows get equal results;
with no islands to train on the field keeps its prior weights.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_sample, map_batches

KINDS = ("email", "ip", "card", "phone")
# Bounds of the training sample, of an island's length around its digits, and of a segment.
SAMPLE_DOCS = 20_000
SAMPLE_ISLANDS = 600
ISLAND_CHARS = 400
MARGIN = 24
MAX_TOKENS = 24
MIN_POSTERIOR = 0.95

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SOME = re.compile("[0-9@]")
_RUN = re.compile(r"[0-9@][0-9@\x20().+-]*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)
# No segment holds a line break or a tab.
_LINE = re.compile(r"[^\n\r\t]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without rescanning long runs: the local part is what precedes an ``@``."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, by kind as listed, then start."""
    if not text or not _SOME.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---- islands and candidate segments -------------------------------------------------------------

def islands(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and ``@``, widened by a margin."""
    out: list[list[int]] = []
    for m in _RUN.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_NUMBER_LIKE = re.compile(r"[+(]?[0-9][0-9 ().+-]*")


def candidates(text: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(first token, end token, kind, start, end) of the segments worth scoring in a stretch of text, by first token.

    Every candidate begins and ends at token borders, has at most MAX_TOKENS
    tokens and holds what its kind can't do without.  Tokens are numbered in
    the stretch, offsets are those of the text.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, len(text) if hi is None else hi)]
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        if not (first.isalnum() or first in "+("):
            continue
        digits = ats = dots = 0
        numeric = not first.isalpha()
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            s, e = tokens[j]
            c = text[s]
            if c in "\n\r\t":
                break
            if "0" <= c <= "9":
                digits += e - s
            elif c == "@":
                ats += 1
            elif c == ".":
                dots += 1
            elif c.isalpha() or c not in " ()+-":
                numeric = False
            if digits > 40 and not ats:
                break
            if not (c.isascii() and c.isalnum()):
                continue
            span = (i, j + 1)
            if ats == 1 and dots and first.isalnum() and (e - a) <= 120 and " " not in text[a:e]:
                yield (*span, 0, a, e)
            if numeric and not ats:
                if dots == 3 and 4 <= digits <= 12 and first.isdigit():
                    yield (*span, 1, a, e)
                if 13 <= digits <= 19 and first.isdigit():
                    yield (*span, 2, a, e)
                if 7 <= digits <= 15 and (j > i or digits >= 10):
                    yield (*span, 3, a, e)
            if not numeric and not ats and j - i > 16:
                break


def _parts(text: str, lo: int, hi: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Candidates of an island in parts, at borders that none of them crosses.

    A token outside segments scores 0, so the field over the island is the
    product of the fields over its parts, whatever its length.
    """
    for line in _LINE.finditer(text, lo, hi):
        part, reach = [], 0
        for cand in candidates(text, *line.span()):
            if part and cand[0] >= reach:
                yield part
                part = []
            part.append(cand)
            reach = max(reach, cand[1])
        if part:
            yield part


FEATURES = ("bias", "glued_before", "glued_after", "blank_before", "blank_after", "pattern", "plus", "parens", "groups_even",
            "separators", "mixed_separators", "luhn", "first_card_digit", "digits_16", "octets", "tld_letters", "double_dot",
            "digits_9_12", "short", "long", "dots")
_F = len(FEATURES)
_P = re.compile(r"[A-Za-z0-9]")
_STRICT = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
           re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}"),
           re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}"))


def segment_features(text: str, kind: int, a: int, b: int) -> np.ndarray:
    """Features of a whole segment, in the block of its kind."""
    s = text[a:b]
    before, after = text[max(0, a - 1):a], text[b:b + 1]
    digits = re.sub("[^0-9]", "", s)
    seps = set(re.sub("[0-9A-Za-z@+()]", "", s))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    f = np.zeros(len(KINDS) * _F)
    f[kind * _F:(kind + 1) * _F] = (
        1, bool(_P.match(before)) or before in "._%+-@" and before != "", bool(_P.match(after)) or after == "@",
        before in " \n", after in " \n", bool(_STRICT[kind].fullmatch(s)), s[0] == "+", "(" in s and ")" in s and s.index("(") < s.index(")"),
        len(set(groups)) == 1 and len(groups) > 1, len(seps) > 0, len(seps - {" "}) > 1, len(digits) >= 13 and luhn(digits),
        s[0] in "3456", len(digits) == 16, kind == 1 and all(len(x) <= 3 and int(x) < 256 for x in re.findall("[0-9]+", s)),
        kind == 0 and s.rpartition(".")[2].isalpha(), ".." in s, 9 <= len(digits) <= 12, len(digits) < 8, len(s) > 60, "." in s)
    return f


# Weights before training: what a strict form and free borders are worth.
PRIOR = {"bias": -3.0, "glued_before": -3.0, "glued_after": -3.0, "pattern": 3.0, "double_dot": -2.0, "mixed_separators": -1.0}
PRIOR_KIND = {("card", "luhn"): 2.0, ("card", "bias"): -4.5, ("ip", "octets"): 1.5, ("email", "tld_letters"): 1.0, ("phone", "plus"): 2.5,
              ("phone", "parens"): 1.0, ("phone", "separators"): 0.5}


def prior_weights() -> np.ndarray:
    w = np.zeros((len(KINDS), _F))
    for name, v in PRIOR.items():
        w[:, FEATURES.index(name)] = v
    for (kind, name), v in PRIOR_KIND.items():
        w[KINDS.index(kind), FEATURES.index(name)] = v
    return w.ravel()


# ---- the field -----------------------------------------------------------------------------------

def _lattice(text: str):
    cands = list(candidates(text))
    n = sum(1 for _ in _TOKEN.finditer(text))
    feats = np.stack([segment_features(text, k, a, b) for _, _, k, a, b in cands]) if cands else np.zeros((0, len(KINDS) * _F))
    return n, cands, feats


def _scores(text: str, cands: list, weights: np.ndarray) -> np.ndarray:
    """Scores of the candidates; few of them hold their features at a time."""
    out = np.zeros(len(cands))
    for at in range(0, len(cands), 1024):
        some = cands[at:at + 1024]
        out[at:at + 1024] = np.stack([segment_features(text, k, a, b) for _, _, k, a, b in some]) @ weights
    return out


def _sums(n: int, cands: list, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and posterior of every candidate; a token outside segments scores 0."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for c, (i, j, *_rest) in enumerate(cands):
        ends.setdefault(j, []).append(c)
        starts.setdefault(i, []).append(c)
    fwd, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        x = fwd[j - 1]
        for c in ends.get(j, ()):
            x = _logadd(x, fwd[cands[c][0]] + scores[c])
        fwd[j] = x
    for i in range(n - 1, -1, -1):
        x = back[i + 1]
        for c in starts.get(i, ()):
            x = _logadd(x, back[cands[c][1]] + scores[c])
        back[i] = x
    post = np.array([math.exp(min(0.0, fwd[i] + scores[c] + back[j] - fwd[n])) for c, (i, j, *_r) in enumerate(cands)])
    return fwd[n], post


def _logadd(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def best_segments(n: int, cands: list, scores: np.ndarray) -> list[int]:
    """Segmentation of highest score (bounded-length dynamic programme); ties prefer fewer, earlier segments."""
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    ends: dict[int, list[int]] = {}
    for c, cand in enumerate(cands):
        ends.setdefault(cand[1], []).append(c)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for c in ends.get(j, ()):
            if (v := best[cands[c][0]] + scores[c]) > best[j]:
                best[j], back[j] = v, c
    out, j = [], n
    while j > 0:
        if back[j] >= 0:
            out.append(back[j])
            j = cands[back[j]][0]
        else:
            j -= 1
    return out[::-1]


def _loosened(text: str, spans: list[tuple[str, int, int]], number: int) -> tuple[str, list[tuple[str, int, int]]]:
    """Every third island with a phone loses its plus sign, as people write it; the span moves along."""
    for k, (kind, a, b) in enumerate(spans):
        if kind == "phone" and number % 3 == 0 and "(" in text[a:b]:
            moved = [(x, s - (s > a), e - (e > a)) for x, s, e in spans]
            moved[k] = (kind, a, b - 1)
            return text[:a] + text[a + 1:], moved
    return text, spans


def train(texts: list[str], rounds: int = 40, rate: float = 0.5, pull: float = 0.02) -> np.ndarray:
    """Maximum likelihood of the silver segments, drawn to the prior weights."""
    prior = prior_weights()
    w = prior.copy()
    data = []
    for number, text in enumerate(texts):
        text, spans = _loosened(text, base_spans(text), number)
        n, cands, feats = _lattice(text)
        if not cands:
            continue
        gold, used = [], -1
        wanted = {(KINDS.index(k), a, b) for k, a, b in spans}
        for c in sorted(range(len(cands)), key=lambda c: (cands[c][3], cands[c][3] - cands[c][4])):
            if tuple(cands[c][2:]) in wanted and cands[c][0] >= used:
                gold.append(c)
                used = cands[c][1]
        data.append((n, cands, feats, feats[gold].sum(axis=0)))
    if not data:
        return w
    square = np.full_like(w, 1e-6)
    for _ in range(rounds):
        grad = -pull * len(data) * (w - prior) / max(1, len(data))
        for n, cands, feats, gold in data:
            _, post = _sums(n, cands, feats @ w)
            grad += (gold - post @ feats) / len(data)
        square += grad * grad
        w += rate * grad / np.sqrt(square)
    return w


def _sample_islands(batch) -> dict:
    out = []
    for text in batch.column(0).to_pylist():
        for a, b in islands(text)[:4] if text else ():
            out.append(text[a:min(b, a + ISLAND_CHARS)])
    return {"island": out}


def fit(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> np.ndarray:
    """Weights from a bounded sample: about SAMPLE_DOCS documents by a hash of their key, at most SAMPLE_ISLANDS islands."""
    n = docs.count()
    picked = docs.where(in_sample("pii", F.col(key_col), SAMPLE_DOCS / max(1, n))).select(F.col(text_col).cast("string").alias("text"))
    found = map_batches(picked.where(F.col("text").rlike("[0-9@]")), _sample_islands, "island string")
    rows = found.orderBy(F.xxhash64("island"), "island").limit(SAMPLE_ISLANDS).collect()
    return train([r.island for r in rows])


def find_spans(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and the spans the field adds to them."""
    base = base_spans(text)
    added: list[tuple[str, int, int]] = []
    if not text or not _SOME.search(text):
        return base, added
    # Base spans as disjoint stretches; segments never overlap one another.
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for lo, hi in islands(text):
        for part in _parts(text, lo, hi):
            first = part[0][0]
            cands = [(i - first, j - first, *rest) for i, j, *rest in part]
            n = max(c[1] for c in cands)
            scores = _scores(text, cands, weights)
            chosen = best_segments(n, cands, scores)
            if not chosen:
                continue
            _, post = _sums(n, cands, scores)
            firsts = [c[0] for c in cands]
            for c in chosen:
                i, j, kind, s, e = cands[c]
                # Segments of this kind that overlap exclude one another: together they say that the kind is here.
                near = range(bisect_left(firsts, i - MAX_TOKENS), bisect_left(firsts, j))
                sure = sum(post[x] for x in near if cands[x][2] == kind and i < cands[x][1])
                k = bisect_left(taken, (e, 0))  # stretches from k on begin at the segment's end or later
                if sure >= MIN_POSTERIOR and not (k and taken[k - 1][1] > s):
                    added.append((KINDS[kind], s, e))
    return base, added


_FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string, n_added bigint"


def detect(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the base spans and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch):
        out: dict[str, list] = {name.split()[0]: [] for name in _FOUND.split(", ")}
        for text in batch.column(1).to_pylist():
            base, added = find_spans(text, shared.value)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_spans"].append(join_spans(base))
            out["spans"].append(join_spans(base + added))
            out["n_added"].append(len(added))
        return out | {"doc_id": batch.column(0)}

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, _FOUND)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = detect(docs, fit(docs, text_col, id_col), id_col, text_col)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text",
         chars_col: str | None = None) -> DataFrame:
    """Documents with personal data masked, same columns; texts without any are unchanged."""
    bound_batches(docs.sparkSession)
    weights = fit(docs, text_col, id_col) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col else None

    def run(batches):
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                base, added = find_spans(text, shared.value)
                if base or added:
                    changed[i] = masked(text, base + added)
            cols = list(batch.columns)
            if changed:
                cols[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if chars is not None:
                    cols[chars] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(cols[chars].to_pylist())],
                                           batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
