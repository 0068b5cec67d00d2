"""Column helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed by the contracts: a word is a run of characters other than these six, and only A-Z are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Words of a text, none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(spark: SparkSession) -> int:
    """Into how many parts a sweep without a key of its own is dealt: as many as the cluster shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
