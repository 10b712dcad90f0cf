"""Rows that every operator must take: nulls in any column, empty and very long texts, ties, repeated rows, odd signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (4, "one", "en", "b", 3),
    (5, f"alpha beta gamma {PASSAGE} delta epsilon.", "en", "b", 1), (6, f"zeta eta\n{PASSAGE}\ntheta iota", "fr", "b", 1),
    (7, LONG, "en", "c", 1), (8, LONG + " end", "en", "c", 1), (9, "é ü 日本語 🙂 naïve\x85\xa0x", "fr", "c", 1),
    (10, f"{PASSAGE} {PASSAGE}", "en", "c", 1), (10, f"{PASSAGE} {PASSAGE}", "en", "c", 1), (None, f"{PASSAGE} null id", None, None, None),
    (-5, "aaaa " * 400, "es", "d", 1), (11, "a" * 5000, "es", "d", 1), (12, "one two three four five six seven eight nine ten eleven.", "en", "d", 1),
    (13, "One Two three four five six seven eight nine ten eleven.", "en", "d", 1), (14, "tie tie tie", "en", "d", 1), (15, "tie tie tie", "en", "d", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession) -> DataFrame:
    """With extra columns whose names are also in results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({"kept": F.lit("x"), "score": F.lit(1), "key": F.lit("k"), "doc": F.lit(0), "spans": F.lit(None).cast("string"), "fp": F.lit(2)})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def by_id(rows) -> dict:
    return {r.doc_id: r for r in rows}
