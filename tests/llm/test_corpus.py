"""Problems 7, 8 and 9: packing, mixing and languages."""

import itertools
import random

import numpy as np
import pytest

from lodeweave.llm import language as L
from lodeweave.llm import mixture as X
from lodeweave.llm import packing as P
from lodeweave.llm import tokens


def optimum(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bounds_and_best_fit(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted((rng.randrange(1, 31) for _ in range(9)), reverse=True))
    place = P.best_fit(sizes, 30)
    for b in set(place):
        assert sizes[place == b].sum() <= 30
    assert P.lower_bound(sizes, 30) <= optimum(sizes.tolist(), 30) <= place.max() + 1


def test_packing_is_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 50)
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 3, 40, 55, 70, 99, 100, 101, 250])) for i in range(400)] + [(999, None)]
    packs = spark.createDataFrame([("s", 100), ("l", 1000), ("x", None)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = P.packed(df, packs).collect()
    for name, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in rows if r.pack_name == name]
        for _, g in itertools.groupby(sorted(mine, key=lambda r: r.container_id), key=lambda r: r.container_id):
            assert sum(r.n_tokens for r in g) <= capacity
        for i, n in sizes:
            parts = sorted((r.first_token, r.n_tokens) for r in mine if r.doc_id == i)
            assert sum(b for _, b in parts) == (n or 0) and len(parts) == -(-(n or 0) // capacity)
    report = {r.pack_name: r for r in P.report(P.packed(df, packs), df, packs).collect()}
    assert all(r.least_containers <= r.containers <= r.least_containers * 1.1 + 1 for r in report.values())
    assert P.packed(df.limit(0), packs).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "你好 world"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.sized(df, "doc_id").collect()}
    assert got[1] > 1 and got[2] == got[3] == 0


def test_pour_gives_the_rest_to_siblings():
    assert X.pour(100, {"a": (0.5, 20), "b": (0.25, 1000), "c": (0.25, 1000)}) == {"a": 20, "b": 40.0, "c": 40.0}
    assert sum(X.pour(100, {"a": (1, 10), "b": (1, 20)}).values()) == 30


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, s, "zh", rng.randrange(10, 60)) for i, s in enumerate(["big_01"] * 300 + ["big_02"] * 200 + ["small_01"] * 10)] + [(900, "other", "zh", 50), (901, None, None, 5), (902, "big_01", None, 0)]
    targets = spark.createDataFrame([("big_01", 0.4, 2), ("big_02", 0.4, 2), ("small_01", 0.1, 3), ("none_01", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_tokens long")
    used, shares = X.mixed(df, targets)
    rows = used.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.times <= {"big_01": 2, "big_02": 2, "small_01": 3}[r.source] for r in rows)
    got = {r.source: r for r in shares.collect()}
    total = sum(r.tokens for r in got.values())
    assert got["none_01"].tokens == 0 and got["small_01"].most_repeats == 3
    assert abs(got["big_01"].tokens / got["big_02"].tokens - 1) < 0.02 and abs(total - sum(n for _, s, _, n in docs if s in got)) < 0.02 * total
    assert X.mixed(df.limit(0), targets)[0].count() == 0


TEXTS = {
    "zh": "这款保温杯用了三天还是很好用。客服态度也不错，下次还会回购。", "en": "The vacuum flask was still easy to clean after nine days. We bought it in the live room.", "ja": "この水筒は思ったより小さいです。友人が勧めていた枕を買いました。",
    "ko": "이웃 말로는 좋다고 했지만 실제로는 생각보다 작아요. 포장이 꼼꼼했어요 정말.", "ru": "Соседка показала другую модель, и куртка оказалась меньше. Через семь дней она лёгкая.", "es": "Compré la almohada por nueve euros y es muy cómoda. El vendedor dijo que era bastante ligera.", "pt": "Comprei a panela elétrica por nove e não é bem leve. É preciso conferir o tamanho antes.",
}


def test_code_lengths_are_those_of_the_trees():
    """The array form against a plain walk of the contexts."""
    import math

    trees = L.Trees({c: [t.encode()] for c, t in TEXTS.items()})
    text = "这款 el vendedor 水筒xyz".encode()
    got = trees.lengths(np.frombuffer(text, np.uint8), np.array([0]))[0]
    for j, c in enumerate(L.CODES):
        counts: dict[bytes, dict[int, int]] = {}
        data = TEXTS[c].encode()
        for i, s in enumerate(data):
            for k in range(min(i, L.ORDER) + 1):
                counts.setdefault(data[i - k : i], {}).setdefault(s, 0)
                counts[data[i - k : i]][s] += 1
        bits = 0.0
        for i, s in enumerate(text):
            for k in range(min(i, L.ORDER), -1, -1):
                if seen := counts.get(text[i - k : i]):
                    n, d = sum(seen.values()), len(seen)
                    if s in seen:
                        bits -= math.log2(seen[s] / (n + d))
                        break
                    bits -= math.log2(d / (n + d))
            else:
                bits += 8
        assert abs(bits - got[j]) < 0.01 * bits


def test_languages(spark):
    rows = [(i, TEXTS[c] + str(i), c) for i, c in enumerate(list(TEXTS) * 6)]
    rows += [(100, TEXTS["zh"] + " " + TEXTS["es"], "zh-CN"), (101, TEXTS["ru"], "en"), (102, "", "en"), (103, None, None), (104, "00:33:04,000 --> 00:33:13,579\nSolbén", "und"), (105, TEXTS["ko"], "Korean"), (106, TEXTS["zh"] * 3000, "chinese")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, code string, first int").repartition(3)
    found = {(r.doc_id, r.lang_code) for r in L.unnamed(L.parts(df)).collect()}
    assert found == {(100, "es"), (101, "ru")}
    main = {r.doc_id: r.lang_code for r in L.main_language(L.parts(df)).collect()}
    assert main[106] == "zh" and main[105] == "ko" and 102 not in main
    assert L.parts(df.limit(0)).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    given = ["zh_Hans", "ZH", "en-US", "Portuguese", "jpn", "und", "unknown", "", None, " es-MX ", "Brazilian Portuguese"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, lang string").select("i", L.named(F.col("lang")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == ["zh", "zh", "en", "pt", "ja", None, None, None, None, "es", "pt"]
