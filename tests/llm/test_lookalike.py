"""Problem 3 on stated cases."""

import pytest

from lodeweave.llm import lookalike as L

CASES = [
    ("好‌用", "好用"), ("Ｍarapex的鞋", "Marapex的鞋"), ("用了１２９回", "用了129回"), ("Ondíre", "Ondíre"), ("Таvіscо的外套", "Tavisco的外套"), ("奶⽩款", "奶白款"), ("不防水", "不防水"),
    ("花62　块", "花62 块"), ("Q/ΒRΙX 70", "Q/BRIX 70"), ("95％", "95%"), ("３．95", "3.95"), ("КW930-38", "KW930-38"), ("好‍用", "好用"), ("👍‍好", "👍好"), ("Zоë-Rау", "Zoë-Ray"), ("x­y", "xy"),
    ("", ""), ("好，不错！（真）：；？", "好，不错！（真）：；？"), ("👩‍👧❤️", "👩‍👧❤️"), ("α-熊果苷", "α-熊果苷"), ("784μL", "784μL"), ("Отличное качество", "Отличное качество"), ("Éclanne", "Éclanne"), ("15×3", "15×3"), ("℃", "℃"),
]


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(i, "review", 0, t) for i, (t, _) in enumerate(CASES)] + [(99, "review", 0, None), (100, "ocr", 1, "ａ" * 50_000)]
    df = spark.createDataFrame(rows, "sample_id long, field_name string, item_no int, text string").repartition(3)
    return {r.sample_id: r.clean for r in L.rewritten(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: ascii(CASES[i][0]))
def test_case(clean, i):
    given, want = CASES[i]
    assert clean.get(i, given) == want
    assert (i in clean) == (given != want)


def test_long_and_null(clean):
    assert 99 not in clean and clean[100] == "a" * 50_000


def test_classes_are_transitive():
    group = next(g for g in L.classes() if "A" in g)
    assert {"A", "Ａ", "А", "Α"} <= set(group)


def test_empty(spark):
    assert L.rewritten(spark.createDataFrame([], "sample_id long, field_name string, item_no int, text string")).count() == 0
