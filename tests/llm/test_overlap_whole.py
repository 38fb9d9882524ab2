"""Problem 5 on texts whose length says nothing about their similarity, and on hot segments."""

import pytest

from lodeweave.llm import near, overlap

TEXT = "家人们看过来这款行车记录仪用的是磨砂软壳续航够久走两万步也不发烫而且打理不费劲"


def found(spark, train, evaluation):
    make = lambda xs: spark.createDataFrame([("ocr", x) for x in xs], "field_name string, text string")
    return overlap.overlaps(make(train), make(evaluation)).collect()


@pytest.mark.parametrize("times", [2, 5])
def test_repeated_text_is_found(spark, times):
    long = TEXT * times
    assert near.jaccard(TEXT, long) >= near.THRESHOLD
    rows = found(spark, [TEXT, long], [TEXT, long])
    assert sorted(round(r.similarity, 9) for r in rows) == sorted([1.0, 1.0] + 2 * [round(near.jaccard(TEXT, long), 9)])


def test_segments_outnumber_places_of_damage():
    for n in range(near.MIN_CHARS, 5000):
        assert overlap.n_segments(n) > int(0.4 * (n - 2) / 3.8)
        bounds = overlap.segments("x" * n)
        assert all(overlap.SHORT <= z - a <= overlap.LONG for a, z in bounds) and bounds[-1][1] == n


def test_hot_segments_are_split_and_lose_nothing(spark, monkeypatch):
    """One phrase in every text: its shard has several cells on both sides."""
    monkeypatch.setattr(overlap, "TRAIN_ROWS", 7)
    monkeypatch.setattr(overlap, "EVAL_ROWS", 5)
    monkeypatch.setattr(overlap, "SHARD_CHARS", 300)
    monkeypatch.setattr(overlap, "PAIRS_AT_ONCE", 10)
    train = [f"{TEXT[:12]}{i:02d}{TEXT[12:]}" for i in range(30)] + ["无关的文字" * 8]
    evaluation = [f"{TEXT}{i:02d}" for i in range(25)]
    got = {(r.train_key, r.eval_key) for r in found(spark, train, evaluation)}
    want = {(overlap._key(a), overlap._key(b)) for a in train for b in evaluation if near.jaccard(a, b) >= near.THRESHOLD}
    assert got == want and len(want) == 30 * 25


def test_merged_coverage(spark):
    row = lambda e, spans: (e, "ocr", "k", 20, [{"a": a, "z": z} for a, z in spans])
    pairs = spark.createDataFrame([row(1, [(0, 5), (5, 10)]), row(1, [(5, 10), (15, 20)]), row(2, [(0, 5)])], "eval_id long, field_name string, eval_key string, eval_chars int, spans array<struct<a:int,z:int>>")
    assert {r.eval_id: r.coverage for r in overlap.merged(pairs).collect()} == {1: 0.75, 2: 0.25}
