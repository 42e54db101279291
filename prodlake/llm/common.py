"""Shared helpers: words of a text, scratch tables, the given tables."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

__all__ = ["BLANKS", "GAP", "packed", "release", "stored", "table", "word_count", "words"]

# Fixed by the contracts: white space is blank, tab, \n, \v, \f and \r.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now.

    They go when the driver's JVM collects its garbage, which may be long after the tables made
    from them are stored; until then they hold the executors' disks.  A plan is let go in two
    steps (Python's handle first, then what the JVM kept behind it), so garbage is collected twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # handles are given back in the background


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``row`` beside ``columns``, so that no name of theirs can
    clash with one used on the way; ``select("row.*")`` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")
