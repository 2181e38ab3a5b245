"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score double, kept boolean, rate double, component_id bigint, spans string")


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows of (doc_id, text[, lang]); the other columns clash with names that operators return."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 9.0, False, 7.0, -1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n: int, seed: int = 0, vocab: int = 5000) -> str:
    import random
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null id, null text, empty, blank, one word, very long, repeated rows."""
    long = words(60_000, 9)
    return [(1, words(80, 1)), (1, words(80, 1)), (2, None, None), (3, ""), (4, " \n\t "), (5, "one"), (6, long), (None, words(70, 2)),
            (7, "x" * 200_000), (8, "\n".join(["same line here"] * 30)), (9, "1" * 50_000 + " a@b " + "@" * 500)]
