"""What the text operators share: reading tables, words, and wrapping of input rows.

Input rows travel through an operator as one struct, ``row``. So a table may
carry extra columns of any name without clashing with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Separators of the two kinds of words, as character classes
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wrap(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, text): the input row (or its columns ``carry``) as a struct, and its text with null as empty."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def unwrap(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def blank_words(text: Column) -> Column:
    """Words between blanks, as an array."""
    return F.array_remove(F.split(text, BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all that is not ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), "")
