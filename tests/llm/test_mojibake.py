"""Problem 2: planted damage comes out and is repaired; correct texts do not come out."""

import random

import pytest

from lodeweave.llm import mojibake as M

WORDS = ["这个牌子的衣服穿着很舒服", "客服态度不错", "物流很快包装也好", "颜色跟图片一样", "用了三天就坏了", "推荐给朋友", "质量超出预期", "味道有点冲", "洗完缩水了", "下次还会回购"]
FINE = ["Отличное качество, спасибо", "とても気に入りました", "배송이 빨라요 좋아요", "déjà vu, très bien", "Muy cómodo, niño feliz", "Éclanne的精华水β-葡聚糖", "好用👩‍👧❤️", "很好囍", "São ótimos", "Таvіscо的鞋", "Né­la的 包"]


def high(b):
    return "".join(bytes([x]).decode("cp1252") if bytes([x]).decode("cp1252", "ignore") else chr(x) for x in b)


DAMAGE = {
    "cp1252": lambda t: high(t.encode()), "latin1": lambda t: t.encode().decode("latin-1"), "twice": lambda t: high(high(t.encode()).encode()), "mac": lambda t: t.encode().decode("mac_roman"),
    "gbk shown": lambda t: t.encode("gbk").decode("latin-1"), "gbk big5": lambda t: t.encode("gbk").decode("big5", "replace"), "utf8 gbk": lambda t: t.encode().decode("gbk", "replace"), "lost": lambda t: t.encode().decode("ascii", "replace"),
}


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows, bad = [], {}
    for i in range(3000):
        text = "，".join(rng.sample(WORDS, 3))
        if i % 40 == 0:
            kind = list(DAMAGE)[i // 40 % len(DAMAGE)]
            part = rng.choice(WORDS)
            rows.append((i, "review", 0, None, "a", text[:8] + DAMAGE[kind](part) + "。"))
            bad[i] = (kind, text[:8] + part + "。")
        else:
            rows.append((i, "review", 0, None, "a", text))
    rows += [(10_000 + i, "review", 0, None, None, t) for i, t in enumerate(FINE * 3)] + [(20_000, "review", 0, None, "a", None), (20_001, "review", 0, None, "a", ""), (20_002, "review", 0, None, "a", "好" * 100_000)]
    df = spark.createDataFrame(rows, "sample_id long, field_name string, item_no int, ref string, source string, text string").repartition(3)
    from lodeweave.session import cut

    return cut(M.garbled(df)), bad


def test_found(judged):
    found = {r.sample_id for r in judged[0].filter("posterior >= 0.5").collect()}
    assert found == set(judged[1])


def test_repaired(judged):
    got = {r.sample_id: r for r in M.repaired(judged[0]).collect()}
    whole = [i for i, (kind, _) in judged[1].items() if kind in ("cp1252", "latin1", "twice", "mac", "gbk shown")]
    assert sum(got[i].repaired_text == judged[1][i][1] and got[i].recoverable for i in whole) >= 0.9 * len(whole)
    assert not any(got[i].recoverable for i, (kind, _) in judged[1].items() if kind == "lost")


def test_empty(spark):
    df = spark.createDataFrame([], "sample_id long, field_name string, item_no int, ref string, source string, text string, posterior double")
    assert M.garbled(df).count() == 0
