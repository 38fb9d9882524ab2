"""Documents packed into containers of fixed capacity (problem 7).

Partitions of at most PART documents in expectation are packed by best-fit decreasing. Lower
bounds from dual-feasible functions certify a partition whose containers reach them. Partitions
with a gap release the documents of their badly filled containers; the released documents of FAN
such partitions are packed together again, and what needs fewer containers is kept. A text larger
than the capacity is divided into full containers and one rest; no other text is divided.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.session import cut, ship

#: Documents of a partition; partitions whose released documents meet; filling below which a container is released.
PART, FAN, RELEASE = 10_000, 4, 0.98
PLACED = "pack_name string, capacity int, part string, bin int, doc_id long, piece_no int, n_tokens int, bins int, bound int"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item by best fit, the sizes in descending order."""
    place = np.empty(len(sizes), dtype=np.int32)
    open_: dict[int, list[int]] = {}
    mask = count = 0  # bit r of the mask: a container with r tokens left
    for i, s in enumerate(sizes.tolist()):
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            stack = open_[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            r, b = capacity, count
            count += 1
        place[i] = b
        if r > s:
            open_.setdefault(r - s, []).append(b)
            mask |= 1 << (r - s)
    return place


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of the sizes needs."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs, from the number of items of each size up to the capacity:
    the best of three families of dual-feasible functions."""
    count = count.astype(np.int64)
    if not count.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # large items count as whole, small ones below e as nothing
    number, volume = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    inner = volume[capacity - e] - volume[e - 1]
    whole = number[-1] - number[capacity - e]
    best = max(best, int((whole + -(-inner // capacity)).max(initial=0)))
    # rounding to multiples of 1 / k
    for k in range(1, 51):
        up = np.where(x * (k + 1) % capacity == 0, x * k, (x * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * up).sum()) // (k * capacity)))
    # items above one half by what fits beside them in units of t, smaller ones as one unit; t at quantiles of the small sizes
    small = number[capacity // 2]
    for t in np.unique(np.searchsorted(number, np.linspace(0, small, 64), side="left")) if small else ():
        if 0 < t <= capacity // 2:
            units = capacity // t
            f = np.where(2 * x > capacity, units - (capacity - x) // t, np.where(x >= t, 1, 0))
            best = max(best, -(-int((count * f).sum()) // int(units)))
    return best


def _pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
    sizes, capacity = table.column("n_tokens").to_numpy(), table.column("capacity")[0].as_py()
    place = best_fit(sizes, capacity)
    n, bound = int(place.max()) + 1, lower_bound(sizes, capacity)
    rows = table.num_rows
    table = table.append_column("bin", pa.array(place)).append_column("bins", pa.array(np.full(rows, n, np.int32))).append_column("bound", pa.array(np.full(rows, bound, np.int32)))
    yield from table.select(["pack_name", "capacity", "part", "bin", "doc_id", "piece_no", "n_tokens", "bins", "bound"]).to_batches()


def _packed(items: DataFrame) -> DataFrame:
    return cut(items.select("pack_name", "capacity", "part", "doc_id", "piece_no", "n_tokens").groupBy("pack_name", "part").applyInArrow(_pack, PLACED))


def pieces(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """Items of each pack: pack_name, capacity, doc_id, piece_no, n_tokens; texts without a token are no items.

    ``sizes``: doc_id, n_tokens. ``packs``: a few rows pack_name, capacity_tokens; those with a
    NULL or no capacity are ignored.
    """
    packs = packs.filter("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    chosen = [tuple(r) for r in packs.collect()]
    options = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in sorted(chosen)]) if chosen else F.expr("cast(array() as array<struct<pack_name:string,capacity:int>>)")
    rows = sizes.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("n"), F.explode(options).alias("p")).select("doc_id", "n", "p.*")
    cut_up = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))))
    return cut_up.select("pack_name", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).cast("int").alias("n_tokens"))


def packed(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, container_id, doc_id, piece_no, first_token, n_tokens of every item.

    Empty tables give no rows. doc_id is unique; rows that repeat one are items of their own.
    """
    ship(sizes.sparkSession)
    count = max(1, -(-sizes.count() // PART))
    items = pieces(sizes, packs).withColumn("part", F.concat(F.lit("0-"), F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("string")))
    settled, current = [], _packed(items)
    for number in count_from(1):  # each round has a FANth of the partitions of the last, until none has a gap or gains
        parts = current.groupBy("pack_name", "part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        gaps = cut(parts.filter("bins > bound").withColumn("target", F.concat(F.lit(f"{number}-"), F.floor((F.row_number().over(W.partitionBy("pack_name").orderBy("part")) - 1) / FAN).cast("string"))))
        if gaps.limit(1).count() == 0:
            break
        marked = current.join(gaps.select("pack_name", "part", "target"), ["pack_name", "part"], "left")
        fill = F.sum("n_tokens").over(W.partitionBy("pack_name", "part", "bin")) / F.col("capacity")
        marked = cut(marked.withColumn("free", F.col("target").isNotNull() & (fill < RELEASE)))
        before = marked.filter("free").select("pack_name", "target", "part", "bin").distinct().groupBy("pack_name", "target").agg(F.count("*").alias("old"))
        again = _packed(marked.filter("free").drop("part", "bins", "bound").withColumnRenamed("target", "part"))
        better = again.groupBy("pack_name", "part").agg(F.first("bins").alias("new")).join(before.withColumnRenamed("target", "part"), ["pack_name", "part"]).filter("new < old").select("pack_name", F.col("part").alias("target"), F.lit(True).alias("better"))
        better = cut(better)
        kept = marked.join(better, ["pack_name", "target"], "left").filter("not free or better is null").drop("target", "free", "better")
        settled.append(kept.select(*[c.split()[0] for c in PLACED.split(", ")]))
        current = again.join(better.withColumnRenamed("target", "part"), ["pack_name", "part"], "left_semi")
        if current.limit(1).count() == 0:
            break
    for rows in settled:
        current = current.unionByName(rows)
    return current.select("pack_name", F.concat_ws("/", "pack_name", "part", F.col("bin").cast("string")).alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), "n_tokens")


def report(placed: DataFrame, sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """Containers, certified least number of containers, tokens and filling of each pack.

    The bound comes from the numbers of items of each size, at most as many as the capacity.
    """
    spark = placed.sparkSession
    sized = pieces(sizes, packs).groupBy("pack_name", "capacity", "n_tokens").count().collect()
    bounds = []
    for name, capacity in {(r[0], r[1]) for r in sized}:
        count = np.zeros(capacity + 1, dtype=np.int64)
        for r in sized:
            if (r[0], r[1]) == (name, capacity):
                count[r[2]] = r[3]
        bounds.append((name, capacity, bound_of_counts(count, capacity)))
    known = spark.createDataFrame(bounds, "pack_name string, capacity int, least_containers long")
    counts = placed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"))
    return counts.join(known, "pack_name").withColumn("filling", F.col("tokens") / (F.col("containers") * F.col("capacity")))
