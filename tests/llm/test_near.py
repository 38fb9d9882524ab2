"""Problems 5 and 6 against brute force on texts with edits, copies and reordering."""

import random

import pytest

from lodeweave.llm import near, neardup, overlap


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面") for _ in range(rng.randrange(30, 160))) for _ in range(n)]
    out = list(base)
    for t in base:
        for edits in (1, len(t) // 30, len(t) // 14):
            x = list(t)
            for _ in range(edits):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([["换"], [], [x[k], "加"]])
            out.append("".join(x))
        cut = len(t) // 2
        out.append(t[cut:] + t[:cut])
    return [t for t in out if len(t) >= near.MIN_CHARS]


def brute(a, b):
    return {(x, y) for x in a for y in b if x != y and near.jaccard(x, y) >= near.THRESHOLD}


def test_reduced_and_runs(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("a，b 1！\U0001f600é",)], "t string").select(near.reduced(F.col("t")).alias("x")).first().x == "ab1é"
    runs, starts = near.run_arrays(["abcd", "xyz"])
    assert len(runs) == 3 and list(starts) == [0, 2]


def test_near_pairs_recall(spark):
    texts = corpus(1) + ["好" * 5000, "好" * 40]
    df = neardup.classes(spark.createDataFrame([(t,) for t in texts + texts[:5]], "text string").repartition(3))
    got = {(r.a, r.b) for r in neardup.near_pairs(df).collect()}
    want = {(min(p), max(p)) for p in brute(texts, texts)}
    assert not got - want and len(got & want) >= 0.97 * len(want)


def test_empty_pairs(spark):
    assert neardup.near_pairs(neardup.classes(spark.createDataFrame([], "text string"))).count() == 0


@pytest.mark.parametrize("shard", [10**9, 2000])
def test_overlaps_are_whole(spark, shard, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_CHARS", shard)
    texts = corpus(2)
    train, evaluation = texts[::2] + texts[:3], texts[1::2] + texts[:3]
    make = lambda xs: spark.createDataFrame([("passage", x) for x in xs], "field_name string, text string").repartition(2)
    import hashlib

    name = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    rows = overlap.overlaps(make(train), make(evaluation)).collect()
    got = {(name[r.train_key], name[r.eval_key]) for r in rows}
    want = brute(set(train), set(evaluation)) | {(t, t) for t in set(train) & set(evaluation)}
    assert got == want
    assert all(0 < r.coverage <= 1 for r in rows) and all(r.coverage == 1 for r in rows if r.train_key == r.eval_key)


def test_no_evaluation(spark):
    none = spark.createDataFrame([], "field_name string, text string")
    assert overlap.overlaps(none, none).count() == 0


def test_coverage_merges_intervals():
    assert overlap.coverage([(0, 5), (3, 8), (8, 10)], 20) == 0.5


def test_shares_equal_set_arithmetic():
    texts = corpus(3, 12) + ["好" * 40, "好" * 90]
    left, right = zip(*((a, b) for a in texts for b in texts))
    assert near.shares(list(left), list(right)).tolist() == pytest.approx([near.jaccard(a, b) for a, b in zip(left, right)])


@pytest.mark.parametrize("hot", [2, 3, 1000])
def test_hot_keys_are_divided_and_lose_nothing(spark, hot, monkeypatch):
    """Many copies of one text with one character changed: every band key is hot."""
    monkeypatch.setattr(neardup, "HOT", hot)
    base = corpus(4, 1)[0]
    texts = sorted({base[:i] + "甲乙丙丁"[i % 4] + base[i + 1 :] for i in range(0, len(base), 2)})
    got = {(r.a, r.b) for r in neardup.near_pairs(neardup.classes(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))).collect()}
    want = {(min(p), max(p)) for p in brute(texts, texts)}
    assert not got - want and len(got) >= 0.99 * len(want) and len(want) > 400


def test_bit_map_holds_its_numbers(spark):
    import numpy as np

    numbers = [0, 1, -1, 2**62, -(2**63), 64, 63]
    known = near.bit_map(spark.createDataFrame([(n,) for n in numbers], "n long"), "n")
    assert near.held(known, np.array(numbers)).all() and not near.held(known, np.array([2, 65, 128, 1 << 20])).any()
    assert not near.held(near.bit_map(spark.createDataFrame([], "n long"), "n"), np.array(numbers)).any()


def test_parts_hold_every_row_once():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 3_500_000, 1, 2_000_000, 2_000_000, 7)] + [None] + ["b"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    got = [p.column(0).to_pylist() for p in near.parts(batch, 1, rows=10)]
    assert [i for p in got for i in p] == list(range(len(texts))) and max(map(len, got)) <= 10 and [1] in got
    assert list(near.parts(batch.slice(0, 0), 1)) == []


def test_nulls_short_and_very_long_texts(spark):
    """NULLs and short texts are left out, very long ones compared whole."""
    rng = random.Random(5)
    long = "".join(chr(rng.randrange(0x4E00, 0x8E00)) for _ in range(200_000))
    edited = long[:100_000] + "插入" + long[100_000:150_000] + long[150_003:]
    texts = [long, edited, long[::-1], None, "", "短"]
    df = spark.createDataFrame([("ocr", t) for t in texts] + [(None, long)], "field_name string, text string")
    assert [(r.a, r.b) for r in neardup.near_pairs(neardup.classes(df)).collect()] == [(min(long, edited), max(long, edited))]
    rows = overlap.overlaps(df.filter("text is null or text <> ''"), df).collect()
    assert sorted((r.train_key, r.eval_key) for r in rows) == sorted((overlap._key(a), overlap._key(b)) for a, b in [(long, long), (edited, edited), (long, edited), (edited, long), (long[::-1], long[::-1])])
