"""The corpus pipeline: documents to a masked, deduplicated, weighted training set.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written and read back as the next one's input;
all but the last return the columns of ``docs``:

* language id: documents without a recognised language go, a missing ``lang`` is filled;
* MinHash near-dedup: one document of each group stays;
* benchmark decontamination: passages of benchmark items are cut out, documents that consist of them go;
* personal data: spans are masked;
* mixing: documents get the rate and the number of copies that bring expected domain totals to their
  targets; rate 0 drops a document.

Empty tables pass through every stage; null texts go with the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import decontaminate, langid, mixing, neardup, pii
from tracelens.llm.common import bound_batches, ensure_checkpoint_dir, materialize, read_table
from tracelens.llm.queries import MIX_TARGETS, mixing_labels


def _chars(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), chars_col=_chars(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, chars_col=_chars(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.attach_rates(docs, mixing_labels(spark, sf_dir), MIX_TARGETS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("mix_to_targets", mix_to_targets),
]

# The trained stages have no SQL form; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
