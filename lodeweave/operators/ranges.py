"""Joins of intervals on overlap, by buckets of the axis instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _bucketed(df: DataFrame, a: str, z: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(a) / width), F.floor((F.greatest(F.col(z) - 1, F.col(a))) / width)
    return df.withColumn("__b", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs with the same key whose intervals overlap by more than nothing, with the overlap.

    left: key, l_start, l_end, ...; right: key, r_start, r_end, ...; other columns must differ.
    Both sides are cut at bucket borders and joined on key and bucket; a pair counts in the first
    bucket both have, so that no distinct is needed. Empty intervals overlap nothing.
    """
    x, y = _bucketed(left, "l_start", "l_end", width), _bucketed(right, "r_start", "r_end", width)
    met = x.join(y, [key, "__b"])
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    first = F.floor(F.greatest("l_start", "r_start") / width) == F.col("__b")
    return met.withColumn("overlap", overlap).filter((F.col("overlap") > 0) & first).drop("__b")


def best_overlap(left: DataFrame, right: DataFrame, key: str, by: list[str], order: str, width: int = 64) -> DataFrame:
    """The right row of most overlap for each left row (identified by ``by``), the first in ``order`` of equal ones."""
    w = W.partitionBy(*by).orderBy(F.desc("overlap"), order)
    return overlap_join(left, right, key, width).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
