"""Problem 1: groups, greedy assignment against simulation, broken groups."""

import random

import pytest

from lodeweave.llm import splits as S


def simulate(sizes):
    total = sum(s * n for s, n in sizes.items())
    have = dict.fromkeys(S.TARGETS, 0)
    out = {s: dict.fromkeys(S.TARGETS, 0) for s in sizes}
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            k = max(S.TARGETS, key=lambda k: round(S.TARGETS[k] * 10_000) * total - have[k] * 10_000)
            have[k] += s
            out[s][k] += 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_share_out_is_the_greedy_rule(seed):
    rng = random.Random(seed)
    sizes = {rng.randrange(1, 60): rng.randrange(1, 40) for _ in range(rng.randrange(1, 8))}
    assert S.share_out(sizes) == simulate(sizes)


ROWS = [
    ("a1", "A", "青 Live-1"), ("a2", "A", None), ("b1", "B", "青ＬＩＶＥ-1 "), ("b2", "B", "Room 2"), ("c1", "C", "room2"), ("d1", "D", "UNKNOWN"), ("e1", "E", "unknown"), ("f1", "F", ""),
    ("x1", None, "room2"), ("x2", None, None), ("a1", "A", "青 Live-1"),
]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "pair_id string, product_id string, room_id string")
    got = {r.product_id: r.group for r in S.groups(df).collect()}
    assert got["A"] == got["B"] == got["C"] and len({got[k] for k in "ADEF"}) == 4 and None not in got


def test_assigned_keeps_rows_and_groups(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "pair_id string, product_id string, room_id string, n int, split string")
    rows = S.assigned(df).collect()
    assert len(rows) == len(ROWS) and all(r.assigned_split in S.TARGETS for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.group_key, set()).add(r.assigned_split)
    assert all(len(v) == 1 for v in by.values())
    assert len({r.group_key for r in rows if r.product_id in ("A", "B", "C") or r.pair_id == "x1"}) == 1


def test_shares_of_many_groups(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", f"g{rng.randrange(400)}", None) for i in range(4000)]
    got = [r.assigned_split for r in S.assigned(spark.createDataFrame(rows, "pair_id string, product_id string, room_id string")).collect()]
    assert abs(got.count("train") / 4000 - 0.7) < 0.01 and abs(got.count("val") / 4000 - 0.1) < 0.01


def test_broken(spark):
    df = spark.createDataFrame(ROWS, "pair_id string, product_id string, room_id string")
    marks = spark.createDataFrame([("a1", "train"), ("c1", "val"), ("d1", "test"), ("d1", None), ("zz", "val"), ("f1", "test")], "pair_id string, split string")
    assert {r.product_id for r in S.broken(df, marks).collect()} == {"A", "B", "C"}


def test_empty(spark):
    df = spark.createDataFrame([], "pair_id string, product_id string, room_id string")
    assert S.assigned(df).count() == 0 and S.groups(df).count() == 0
