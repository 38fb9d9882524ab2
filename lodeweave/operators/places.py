"""Places in a total order and exact quantiles, without a window over all rows.

Rows are sorted in range partitions; the sizes of the partitions, a row each, are summed up; a row's
place is its number within the partition plus the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.session import cut


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in an order that must be total; no rows, no places."""
    sorted_ = cut(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted_.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row per partition
    return sorted_.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__at", "__part", "__before")


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, the array ``cut`` of the exact quantiles (linear between neighbours) of a column; NULLs are left out.

    Equal values are counted first, so that only different ones are sorted. Without rows the array is NULL.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    values = numbered(counts, "v")
    # two-level running sum: blocks of neighbouring values, then within a block
    block = F.shiftright("place", 12)
    blocks = values.groupBy(block.alias("b")).agg(F.sum("n").alias("bn"))
    before = blocks.select("b", (F.sum("bn").over(W.orderBy("b")) - F.col("bn")).alias("bo"))
    upto = F.col("bo") + F.sum("n").over(W.partitionBy("b").orderBy("v"))
    runs = values.withColumn("b", block).join(before, "b").select("v", "n", upto.alias("z"))
    total = blocks.agg(F.sum("bn").alias("m"))
    asked = total.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])).alias("q"), "m").select("q.i", ((F.col("m") - 1) * F.col("q.s")).alias("at"))
    ends = asked.select("i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"))
    found = runs.join(F.broadcast(ends), (F.col("k") + 1 <= F.col("z")) & (F.col("k") + 1 > F.col("z") - F.col("n")))
    one = found.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first(F.col("at") - F.floor("at")).alias("w"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("v")))), lambda x: x["v"]).alias("cut"))
