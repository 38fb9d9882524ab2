"""Problem 4 on stated cases."""

import pytest

from lodeweave.operators.quantities import quantities

CASES = [
    ("净含量", "1,080ml*12袋", [1080000]), ("重量", "1斤2两", [600000]), ("重量", "约三斤半", [1750000]), ("容量", "半升", [500000]), ("尺寸", "长55宽45高36cm", [36000, 45000, 55000]),
    ("尺寸（cm）", "５２ｘ２２ｘ３９", [22000, 39000, 52000]), ("高度", "约1米2", [120000]), ("高度", "1米65", [165000]), ("包宽", "二尺一", [70000]), ("规格", "188~593微升", [188, 593]),
    ("保质期", "三年零六个月", [1275000]), ("保质期(月)", "14", [420000]), ("质保期", "七百一十九天", [719000]), ("最佳食用期", "常温12个星期", [84000]), ("上市时间", "2024年3月", []),
    ("出风速度", "不超过14米每秒", []), ("出风速度", "不超过14 m/s", []), ("适用年龄", "3-12岁", []), ("纱支", "60支", []), ("面料含量", "棉65%", []), ("型号", "Orbenna G576", []), ("货号", "ML420-85", []),
    ("毛重", "１５００ｇ(３斤)", [1500000]), ("毛重", "15支装 每支\u200d1,154G", [1154000]), ("重量", "2.05两", [102500]), ("重量", "半公斤", [500000]), ("功率", "1-2kW", [1000000, 2000000]), ("功率", "510毫瓦", [510]),
    ("尺寸", "58mm×21mm×13mm", [1300, 2100, 5800]), ("承重（磅）", "31.65", [14356187]), ("长度", "4.35 英寸", [11049]), ("净含量", "39.5 公升", [39500000]), ("容量", "两升", [2000000]), ("重量", "6两", [300000]),
    ("重量", "两斤半", [1250000]), ("高度", "一尺", [33333]), (None, "500g", [500000]), ("重量", None, []), ("重量", "", []), ("重量", "500", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, 0, k, t) for i, (k, t, _) in enumerate(CASES)], "sample_id long, item_no int, param_key string, raw_text string")
    out: dict[int, set] = {}
    for r in quantities(rows).collect():
        out.setdefault(r.sample_id, set()).add(r.amount)
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{CASES[i][1]}")
def test_case(found, i):
    assert sorted(found.get(i, set())) == CASES[i][2]


def test_long_text_extra_columns_and_repeats(spark):
    text = "约500g " * 2000
    rows = spark.createDataFrame([(1, 0, "重量", text, "x", 1), (1, 0, "重量", text, "x", 1)], "sample_id long, item_no int, param_key string, raw_text string, unit string, amount int")
    assert {tuple(r) for r in quantities(rows).select("sample_id", "item_no", "amount").distinct().collect()} == {(1, 0, 500000)}
    assert quantities(rows.limit(0)).count() == 0


def test_source_default_of_bare_numbers(spark):
    """Below a key without a unit, numbers alone take the unit that the source's other texts agree on; other texts don't."""
    rows = [(i, "FOOD", "净含量", f"{i}克") for i in range(30)] + [(100, "FOOD", "净含量", "250"), (101, "FOOD", "净含量", "共3"), (102, "DIGI", "净含量", "250"), (103, "FOOD", "净含量(kg)", "2"), (104, None, None, "7"), (105, "FOOD", "净含量", "10-20")]
    rows += [(200 + i, "FOOD", "容量", "1升" if i % 2 else "1克") for i in range(40)] + [(300, "FOOD", "容量", "9")]
    df = spark.createDataFrame([(i, 0, s, k, t) for i, s, k, t in rows], "sample_id long, item_no int, source string, param_key string, raw_text string")
    got = {}
    for r in quantities(df).filter("sample_id >= 100 and sample_id < 200 or sample_id >= 300").collect():
        got.setdefault(r.sample_id, []).append(r.amount)
    assert {k: sorted(v) for k, v in got.items()} == {100: [250000], 103: [2000000], 105: [10000, 20000]}


def test_temperatures_have_an_offset(spark):
    df = spark.createDataFrame([(1, 0, "水温", "50℃"), (2, 0, "水温", "212°F"), (3, 0, "容量(ml)", "500 100℃")], "sample_id long, item_no int, param_key string, raw_text string")
    assert sorted((r.sample_id, r.dimension, r.amount) for r in quantities(df).collect()) == [(1, "temperature", 50000), (2, "temperature", 100000), (3, "temperature", 100000), (3, "volume", 500000)]
