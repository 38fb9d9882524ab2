"""Splits that keep related records together (problem 1).

Records tied by a room or a product, also through others, form a group (connected component).
Groups go, the largest first, to the split furthest below its target. Groups of one size are
interchangeable, so that this greedy rule needs only how many groups of each size there are: at
most sqrt(2 n) sizes for n records. For each size the number of groups that the rule gives to each
split is found in closed form, and groups take their split by rank within their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import looks
from lodeweave.operators.assign import share_out
from lodeweave.operators.components import components
from lodeweave.session import cut

TARGETS = {"train": 0.7, "val": 0.1, "test": 0.2}
#: Blocks in which groups of one size are ranked.
BLOCKS = 1024


def room_key(room: Column) -> Column:
    """Room name without case, width and spaces; NULL where it names no room."""
    signs = F.translate(room, looks.CHINESE_SIGNS, "".join(chr(ord(c) - 0xFEE0) for c in looks.CHINESE_SIGNS))
    key = F.lower(F.regexp_replace(looks.plain(signs, letters=False), r"\s+", ""))
    return F.when((key != "") & (key != "unknown"), key)


def groups(records: DataFrame) -> DataFrame:
    """product_id and its group, for all products of the records (product_id, room_id).

    A product without a room is a group of its own. Rows without a product are left out.
    """
    pairs = records.select("product_id", room_key(F.col("room_id")).alias("room")).filter("product_id is not null").distinct()
    tied = components(pairs.filter("room is not null").select(F.concat(F.lit("p:"), "product_id").alias("a"), F.concat(F.lit("r:"), "room").alias("b")))
    of = tied.filter("node like 'p:%'").select(F.expr("substr(node, 3)").alias("product_id"), "component")
    return pairs.select("product_id").distinct().join(of, "product_id", "left").select("product_id", F.coalesce("component", F.concat(F.lit("p:"), "product_id")).alias("group"))


def assigned(records: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The records with their group, its size and their split.

    Columns of the records other than product_id and room_id are kept as they are; the new ones
    are ``group_key``, ``group_size`` and ``assigned_split``. Rows without a product are groups by
    room if they have one, else they share the group of no product. Repeated rows count each.
    """
    spark = records.sparkSession
    group = groups(records)
    keyed = records.withColumn("__room", room_key(F.col("room_id")))
    by_room = cut(keyed.filter("product_id is not null and __room is not null").select("product_id", "__room").distinct().join(group, "product_id").groupBy("__room").agg(F.min("group").alias("room_group")))
    rows = keyed.join(group, "product_id", "left").join(by_room, "__room", "left").withColumn("group_key", F.coalesce("group", "room_group", F.concat(F.lit("r:"), "__room"), F.lit("")))
    rows = rows.drop("__room", "group", "room_group")
    sized = cut(rows.groupBy("group_key").agg(F.count("*").alias("group_size")).withColumn("__block", F.pmod(F.xxhash64("group_key"), F.lit(BLOCKS))))
    counts = {r[0]: r[1] for r in sized.groupBy("group_size").count().collect()}
    names = list(targets)
    ends, plan = [], share_out(counts, targets) if counts else {}
    for s, given in plan.items():
        at = 0
        for k in names:
            at += given[k]
            ends.append((s, k, at))
    limits = spark.createDataFrame(ends, "group_size long, name string, last long").groupBy("group_size").pivot("name", names).agg(F.first("last"))
    before = sized.groupBy("group_size", "__block").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(W.partitionBy("group_size").orderBy("__block")) - F.col("n")).drop("n")
    ranked = sized.join(before, ["group_size", "__block"]).withColumn("__rank", F.col("__before") + F.row_number().over(W.partitionBy("group_size", "__block").orderBy("group_key"))).join(limits, "group_size")
    choice = F.coalesce(*[F.when(F.col("__rank") <= F.col(k), F.lit(k)) for k in names])
    return rows.join(ranked.select("group_key", "group_size", choice.alias("assigned_split")), "group_key")


def broken(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """product_id of the groups whose labelled rows (pair_id, split) carry several splits."""
    group = groups(records)
    of_pair = records.select("pair_id", "product_id").filter("pair_id is not null and product_id is not null").distinct()
    marks = labelled.select("pair_id", "split").filter("split is not null").distinct()
    bad = marks.join(of_pair, "pair_id").join(group, "product_id").groupBy("group").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi")
    return group.join(bad.select("group"), "group", "left_semi").select("product_id")
