"""Greedy assignment of groups to splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.places import numbered

SHARES = {"train": 0.7, "val": 0.1, "test": 0.2}


def share_out(sizes: dict[int, int], targets: dict[str, float] = SHARES) -> dict[int, dict[str, int]]:
    """Groups of each size that greedy largest-first assignment gives to each split.

    Exact: the m groups of size s fill the m largest of the deficits d, d - s, d - 2 s, ... of
    all splits; ties go to the split named first. Deficits are whole numbers of records times 10000.
    """
    total = sum(s * n for s, n in sizes.items())
    deficit = {k: round(v * 10_000) * total for k, v in targets.items()}
    out = {}
    for s in sorted(sizes, reverse=True):
        step, m = s * 10_000, sizes[s]
        above = lambda x: {k: max(0, -((x - d) // step)) if d > x else 0 for k, d in deficit.items()}  # noqa: B023, E731  values of each split above x
        low, high = min(deficit.values()) - step * (m + 1), max(deficit.values())
        while low < high:  # least x with at most m values above it
            mid = (low + high) // 2
            if sum(above(mid).values()) <= m:
                high = mid
            else:
                low = mid + 1
        given = above(low)
        for k, d in deficit.items():
            if sum(given.values()) < m and d >= low and (d - low) % step == 0:
                given[k] += 1
        deficit = {k: d - step * given[k] for k, d in deficit.items()}
        out[s] = given
    return out


def deficit_splits(rows: DataFrame, group: str) -> DataFrame:
    """group, n, split: groups, the largest first, to the split that lacks most rows.

    Only how many groups of each size there are comes to the driver (at most sqrt(2 n) sizes for n
    rows); groups of one size are interchangeable and take their split by their place in it. Rows
    with a NULL group are left out.
    """
    spark = rows.sparkSession
    sized = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    placed = numbered(sized, F.desc("n"), group)
    first, ends = 0, []
    counts = {r[0]: r[1] for r in placed.groupBy("n").count().collect()}
    plan = share_out(counts) if counts else {}
    for s in sorted(counts, reverse=True):
        for k, m in plan[s].items():
            ends.append((s, k, first, first + m))
            first += m
    limits = spark.createDataFrame(ends, "n long, split string, after long, upto long")
    return placed.join(F.broadcast(limits), "n").filter("place > after and place <= upto").select(group, "n", "split")


def balanced_splits(rows: DataFrame, group: str, y: str) -> DataFrame:
    """group, n, pos, split: groups by size, positives (both descending) and name, each to the split where
    the squared relative error of rows plus twice that of positives is least, the first of equal ones.

    The choice for a group depends on all before it, so that one task walks the groups in order;
    it streams over two numbers a group and holds three sums. NULL labels count as 0, rows with a NULL
    group are left out.
    """
    sized = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(y), F.lit(0))).cast("long").alias("pos"))
    placed = numbered(sized, F.desc("n"), F.desc("pos"), group)
    sums = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pos"), F.lit(0))).first()
    goal = {k: (w * sums[0], w * sums[1]) for k, w in SHARES.items()}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = {k: [0, 0] for k in SHARES}

        def error(k: str, n: int, p: int) -> float:
            total = 0.0  # one term after the other: equal errors must compare as equal
            for j in SHARES:
                a, z = have[j][0] + n * (j == k), have[j][1] + p * (j == k)
                total += ((a - goal[j][0]) / max(1.0, goal[j][0])) ** 2
                total += 2.0 * ((z - goal[j][1]) / max(1.0, goal[j][1])) ** 2
            return total

        for frame in batches:
            chosen = []
            for n, p in zip(frame["n"].tolist(), frame["pos"].tolist()):
                k = min(SHARES, key=lambda k: error(k, n, p))  # noqa: B023
                have[k][0] += n
                have[k][1] += p
                chosen.append(k)
            yield pd.DataFrame({"place": frame["place"], "split": chosen})

    plan = placed.select("place", "n", "pos").repartition(1).sortWithinPartitions("place").mapInPandas(walk, "place long, split string")
    return placed.join(plan, "place").select(group, "n", "pos", "split")
