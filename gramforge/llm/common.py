"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import met, shared_cut, shared_dir, stored  # noqa: F401

#: The white space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body uses it.

    Catalyst inlines a projected column into higher-order functions, which would
    evaluate it once per element; a lambda variable can't be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns named, and all of docs in one struct _doc, so that no other column's name can clash."""
    return docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def restored(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of _doc, with new ones in place of those of the same name."""
    return df.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in names))


def word_array(text: Column) -> Column:
    """The words of a text; an empty array for null or a text without words."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through reliable checkpoint files in the shared folder."""
    return shared_cut(df)
