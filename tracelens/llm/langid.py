"""Language identification by hierarchical linear discrimination.

A text is first assigned to a language family (one linear support vector
machine per family against the rest) and then to a language of that family by
one-versus-one machines between its languages.  Both levels read hashed byte
trigrams of the whole text: ASCII letters are lowered, other ASCII bytes count
as blanks, so digits, markup and junk symbols carry no weight.

Defined results: a null text, an empty text and a text without a letter give
``und`` with score 0; ties go to the class that sorts first; repeated rows get
equal results; with no labelled row at all every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize
from .common import bound_batches, in_sample, map_batches

UNDETERMINED = "und"
BUCKET_BITS = 16
CHUNK = 1 << 20
# Bounds of the training sample: rows per language and rows in all, but for at least LEAST_ROWS of every language.
ROWS_PER_LANG = 2000
TRAIN_ROWS = 12_000
LEAST_ROWS = 20
# Predictions below this score are rejected by ``keep_identified``.
MIN_SCORE = 0.25

# Language families by ISO 639-1 code; an unlisted language is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}

_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")
_LETTERS = bytes(c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in range(256))


def family_of(lang: str) -> str:
    for family, langs in FAMILIES.items():
        if lang in langs:
            return family
    return f"only-{lang}"


def trigram_buckets(text: str) -> list[np.ndarray]:
    """Hash buckets of the byte trigrams of a text, in chunks; all-blank trigrams are left out."""
    raw = b" " + text.encode("utf-8", "replace").translate(_LETTERS) + b" "
    out = []
    for i in range(0, max(1, len(raw) - 2), CHUNK):
        a = np.frombuffer(raw[i:i + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(a) < 3:
            break
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        code = code[code != 0x202020]
        out.append((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_ASCII_LETTER.search(text) or _LETTER.search(text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse trigram shares of a text (sorted buckets, values)."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for part in trigram_buckets(text):
        counts += np.bincount(part, minlength=1 << BUCKET_BITS)
    idx = np.flatnonzero(counts)
    return idx.astype(np.int32), (SCALE * counts[idx] / max(1, counts.sum())).astype(np.float32)


SCALE = 30.0


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0,
              epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) by dual coordinate descent."""
    w = np.zeros(1 << BUCKET_BITS)
    bias, alpha = 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows]) + 0.5 / c
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, val = rows[i]
            grad = y[i] * (w[idx] @ val + bias) - 1.0 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - grad / norms[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[idx] += step * val
                bias += step
    return w.astype(np.float32), bias


@dataclass
class LangModel:
    """Family machines and, within each family, one machine per pair of languages."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        parts = trigram_buckets(text)
        total = max(1, sum(len(p) for p in parts))
        margins = self.biases.copy()
        for p in parts:
            for k in range(len(margins)):
                margins[k] += SCALE * float(self.weights[k].take(p).sum(dtype=np.float64)) / total
        conf = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        n = len(self.families)
        best = int(np.argmax(margins[:n])) if n > 1 else 0
        family = self.families[best]
        score = float(conf[best]) if n > 1 else 1.0
        langs = self.langs[family]
        wins = dict.fromkeys(langs, 0.0)
        sure = dict.fromkeys(langs, 1.0)
        for k, (a, b) in enumerate(self.pairs, start=n):
            if a in wins and b in wins:
                p = float(conf[k])
                wins[a if p >= 0.5 else b] += 1
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        lang = max(langs, key=lambda x: (wins[x], sure[x]))
        return lang, min(1.0, max(0.0, score * sure[lang]))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = ROWS_PER_LANG, key_col: str = "doc_id") -> LangModel:
    """Train on at most about ``rows_per_lang`` rows of each language.

    The sample is chosen by a hash of the key, so it does not depend on the
    partitioning; only its hashed features reach the driver.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = materialize(usable.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "languages")
    n_langs = sizes.count()
    if not n_langs:
        return LangModel()
    rows_per_lang = min(rows_per_lang, max(LEAST_ROWS, TRAIN_ROWS // n_langs))
    rows = usable.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), F.col(key_col).alias("__key"))
    rows = rows.join(F.broadcast(sizes) if fits_broadcast(sizes) else sizes, "__lang")
    sample = rows.where(in_sample("langid", F.col("__key"), F.lit(float(rows_per_lang)) / F.col("__n"))).select(
        F.col("__lang").alias("lang"), F.col("__text").alias("text"))
    # The limit only binds when one key is repeated without end.
    rows = map_batches(sample, _sample_features, "lang string, idx binary, val binary").limit(
        2 * rows_per_lang * n_langs).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.idx, r.val))
    data = [(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in rows]
    return fit_rows(data, [r.lang for r in rows])


def _sample_features(batch) -> dict:
    out = {"lang": [], "idx": [], "val": []}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if has_letter(text):
            idx, val = features(text)
            out["lang"].append(lang)
            out["idx"].append(idx.tobytes())
            out["val"].append(val.tobytes())
    return out


def fit_rows(data: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LangModel:
    labels = np.array(langs, dtype=object)
    model = LangModel()
    for lang in sorted(set(langs)):
        model.langs.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.langs)
    model.pairs = [(a, b) for f in model.families for i, a in enumerate(model.langs[f])
                   for b in model.langs[f][i + 1:]]
    fam = np.array([family_of(x) for x in langs], dtype=object)
    machines = []
    for f in model.families:
        y = np.where(fam == f, 1.0, -1.0)
        machines.append(train_svm(data, y) if len(model.families) > 1 else (np.zeros(1 << BUCKET_BITS, np.float32), 1.0))
    for a, b in model.pairs:
        pick = np.flatnonzero((labels == a) | (labels == b))
        machines.append(train_svm([data[i] for i in pick], np.where(labels[pick] == a, 1.0, -1.0)))
    if machines:
        model.weights = np.stack([w for w, _ in machines])
        model.biases = np.array([b for _, b in machines], dtype=np.float64)
    return model


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row; only these two columns are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    out = map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                      run, "doc_id bigint, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, model: LangModel, text_col: str = "text", lang_col: str = "lang",
                    min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is recognised, same columns; a null ``lang_col`` is filled with the prediction.

    Undetermined texts and predictions scored under ``min_score`` go.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            if lang is not None and cols[lang].null_count:
                cols[lang] = pa.array([x if x is not None else p for x, (p, _) in zip(cols[lang].to_pylist(), found, strict=True)],
                                      batch.schema.field(lang).type)
            stay = pa.array([p != UNDETERMINED and s >= min_score for p, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(stay)

    return docs.mapInArrow(run, docs.schema)


def held_out(key_col: str = "doc_id", folds: int = 5):
    """True for rows whose key's CRC-32 falls in fold 0 (a null key is in no fold)."""
    return F.coalesce(F.crc32(F.col(key_col).cast("string")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, key_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(key_col).isNotNull() & ~held_out(key_col))
