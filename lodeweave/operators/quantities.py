"""Quantities in many units brought to common units (problem 4), as native expressions only.

The text is read as it looks (see functions.looks). Regular expressions find quantity groups: one
or more numbers that share a unit (ranges, sides of a size), a half or a decimal tail after the
unit (three litres and a half, 1 metre 65), or a compound of two units. The unit's spelling is
resolved by a join with the alias table; a text without a unit takes that of the parameter key,
else the source default of the key. Factor and offset turn the number into thousandths of the
common unit, rounded half up in decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import looks

# Dimension, thousandths of the common unit as numerator and denominator, spellings.
# Temperatures also have an offset (see OFFSETS).
UNITS = [
    ("temperature", "1000", 1, "℃ °c 摄氏度"), ("temperature", "5000", 9, "℉ °f 华氏度"),
    ("mass", "1000", 1, "g 克 公克"), ("mass", "1000000", 1, "kg 千克 公斤"), ("mass", "1", 1, "mg 毫克"), ("mass", "0.001", 1, "μg ug mcg 微克"),
    ("mass", "500000", 1, "斤 市斤"), ("mass", "50000", 1, "两 市两"), ("mass", "453592", 1, "磅 lb lbs"), ("mass", "28349.5", 1, "盎司 oz"), ("mass", "1000000000", 1, "吨"),
    ("length", "1000", 1, "cm 厘米 公分"), ("length", "100", 1, "mm 毫米"), ("length", "100000", 1, "m 米 公尺"), ("length", "10000", 1, "dm 分米"), ("length", "0.1", 1, "μm um 微米"),
    ("length", "100000000", 1, "km 千米 公里"), ("length", "100000", 3, "尺 市尺"), ("length", "10000", 3, "寸 市寸"), ("length", "2540", 1, "英寸 inch inches 吋"), ("length", "30480", 1, "英尺 ft"),
    ("volume", "1000", 1, "ml 毫升 cc"), ("volume", "1000000", 1, "l 升 公升"), ("volume", "1", 1, "μl ul 微升"), ("volume", "10000", 1, "cl 厘升"), ("volume", "100000", 1, "dl 分升"),
    ("power", "1000", 1, "w 瓦 瓦特"), ("power", "1000000", 1, "kw 千瓦"), ("power", "1", 1, "mw 毫瓦"),
    ("time", "1000", 1, "天 日"), ("time", "7000", 1, "周 星期 个星期 礼拜 个礼拜"), ("time", "30000", 1, "月 个月 个自然月 自然月"), ("time", "365000", 1, "年"),
]
# Fixed value: what is added in thousandths of the common unit after the factor.
OFFSETS = {"℉": "-17777.7778", "°f": "-17777.7778", "华氏度": "-17777.7778"}
#: Keys whose texts may state times; other times are no quantities.
SHELF_LIFE = "保质期|质保期|最佳食用期"
#: A source's default unit of a key: at least so many of its texts state a unit, this share of them the same.
STATED, AGREED = 20, 0.9

_SPELLINGS = sorted((s for *_, names in UNITS for s in names.split()), key=lambda s: (-len(s), s))
_UNIT = "(?:" + "|".join(_SPELLINGS) + ")(?![a-wyz]|x[^0-9 ]|" + r"\s*/\s*(?:s|秒|h|min|小时|分)|每秒|每分|每小时)"
_NUM = r"(?:[0-9]+(?:\.[0-9]+)?|[零〇一二两三四五六七八九十百千万点半]+)"
_SEP = r"\s*(?:[-~～—–―至到x×*]+|长|宽|高|厚|深)\s*"
_LIST = f"{_NUM}(?:{_SEP}{_NUM})*"
_TAIL = rf"(?:半|[0-9]{{1,2}}(?![0-9.]|\s*{_UNIT}|\s*[x×*])|[一二三四五六七八九](?![零一二三四五六七八九十百千]|\s*{_UNIT}))"
_GROUP = rf"(?<![a-z0-9.])(?:{_LIST})\s*{_UNIT}(?:[零又]?{_NUM}\s*{_UNIT}|{_TAIL})?"


def _digit(c: Column, missing: int = 0) -> Column:
    return F.when(c == "", F.lit(missing)).otherwise(F.greatest(F.instr(F.lit("零一二三四五六七八九"), F.translate(c, "〇两", "零二")) - 1, F.lit(0)))


def chinese_number(s: Column) -> Column:
    """Value of a Chinese numeral below 100000 with 半 for a half and 点 before decimals."""
    whole = F.substring_index(s, "点", 1)
    place = lambda name, missing=0: _digit(F.regexp_extract(whole, f"([一二两三四五六七八九]?){name}", 1), missing) * F.when(whole.contains(name), 1).otherwise(0)
    last = _digit(F.regexp_extract(whole, "([一二两三四五六七八九])$", 1))
    weight = F.when(whole.rlike("千[一二三四五六七八九]$"), 100).when(whole.rlike("百[一二三四五六七八九]$"), 10).otherwise(1)
    number = F.when(whole.rlike("^[一二三四五六七八九零〇]{2,}$"), F.expr("try_cast(NULL as int)")).otherwise(place("万", 1) * 10000 + place("千", 1) * 1000 + place("百", 1) * 100 + place("十", 1) * 10 + last * weight)
    decimals = F.when(s.contains("点"), F.concat(F.lit("0."), F.translate(F.substring_index(s, "点", -1), "〇零一二两三四五六七八九", "001223456789"))).otherwise("0")
    return F.when(s == "半", F.lit(0.5)).otherwise(number).cast("decimal(20,6)") + decimals.try_cast("decimal(20,6)")


def number(s: Column) -> Column:
    """Value of a number in digits or Chinese numerals."""
    return F.when(s.rlike("^[0-9]"), s.try_cast("decimal(20,6)")).otherwise(chinese_number(s))


def aliases(spark: SparkSession) -> DataFrame:
    """The alias table: unit, dimension, numerator, denominator, offset."""
    rows = [(s, d, n, q, OFFSETS.get(s, "0")) for d, n, q, names in UNITS for s in names.split()]
    return spark.createDataFrame(rows, "unit string, dimension string, num string, den int, off string").select("unit", "dimension", F.col("num").cast("decimal(14,4)").alias("num"), "den", F.col("off").cast("decimal(14,4)").alias("off"))


def source_defaults(read: DataFrame) -> DataFrame:
    """source, k, du: the unit that the texts of a source and key state, where enough do and agree.

    ``read``: source, k, t. The first unit after a number counts; counts go through one partial aggregation.
    """
    unit = F.regexp_extract("t", rf"[0-9]\s*({_UNIT})", 1)
    told = read.select("source", "k", unit.alias("u")).filter("u <> ''").groupBy("source", "k", "u").agg(F.count("*").alias("n"))
    best = told.groupBy("source", "k").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("u", F.struct("n", "u")).alias("du"))
    return best.filter((F.col("all") >= STATED) & (F.col("most") >= AGREED * F.col("all"))).select("source", "k", "du")


def quantities(params: DataFrame) -> DataFrame:
    """Every quantity of each parameter text: the key columns, dimension, amount.

    ``params``: sample_id, item_no, param_key, raw_text and, if there is one, source. NULL and empty
    texts give no rows, a NULL key names no unit; repeated rows give repeated results. The unit is that of the
    text, else that of the key, else, for a text that is nothing but numbers, the default of its source and key.
    amount: thousandths of the common unit (g, cm, ml, W, day, degree Celsius).
    """
    spark = params.sparkSession
    text = F.regexp_replace(F.lower(looks.plain(F.col("raw_text"))), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    key = F.lower(looks.plain(F.coalesce("param_key", F.lit(""))))
    source = F.coalesce("source", F.lit("")) if "source" in params.columns else F.lit("")
    read = params.select("sample_id", "item_no", source.alias("source"), text.alias("t"), key.alias("k")).filter("t <> ''")
    ku = F.nullif(F.regexp_extract("k", rf"[(\[/_ ]\s*({'|'.join(_SPELLINGS)})\s*[)\]]?\s*$", 1), F.lit(""))
    # only texts that are nothing but numbers in digits (two of the Chinese ones are units too), below a key without a unit, need the default of their source
    lacking = ku.isNull() & F.col("t").rlike(rf"^\s*[0-9.]+(?:{_SEP}[0-9.]+)*\s*$")
    columns = ["sample_id", "item_no", "t", "k"]
    told = read.filter(~lacking).select(*columns, ku.alias("fallback"))
    read = told.unionByName(read.filter(lacking).join(source_defaults(read), ["source", "k"]).select(*columns, F.col("du").alias("fallback")))
    read = read.withColumn("gs", F.regexp_extract_all("t", F.lit(f"({_GROUP})"), F.lit(1)))
    # a text without any unit but those of temperatures: its first list of numbers takes the fallback
    bare = F.regexp_extract("t", f"({_LIST})", 1)
    other = F.exists("gs", lambda g: ~g.rlike("℃|°c|摄氏度|℉|°f|华氏度"))
    read = read.withColumn("gs", F.when(~other & (bare != "") & F.col("fallback").isNotNull(), F.concat("gs", F.array(F.concat(bare, F.col("fallback"))))).otherwise(F.col("gs")))
    group = read.select("sample_id", "item_no", "k", F.explode("gs").alias("g")).withColumn("head", F.regexp_extract("g", rf"^({_LIST})\s*{_UNIT}", 1))
    group = group.withColumn("unit", F.regexp_extract("g", rf"^{_LIST}\s*({_UNIT})", 1)).withColumn("rest", F.regexp_extract("g", rf"^{_LIST}\s*{_UNIT}(.*)$", 1))
    part = group.select("sample_id", "item_no", "k", "unit", F.explode(F.regexp_extract_all("head", F.lit(f"({_NUM})"), F.lit(1))).alias("n"), F.regexp_extract("rest", rf"^[零又]?({_NUM})\s*({_UNIT})$", 1).alias("n2"), F.regexp_extract("rest", rf"^[零又]?{_NUM}\s*({_UNIT})$", 1).alias("unit2"), "rest")
    tail = (
        F.when((F.col("rest") == "") | (F.col("unit2") != ""), F.lit("0"))
        .when(F.col("rest") == "半", F.lit("0.5"))
        .otherwise(F.concat(F.lit("0."), F.translate("rest", "一二三四五六七八九", "123456789")))
        .try_cast("decimal(20,6)")
    )
    table = aliases(spark)
    second = table.select(F.col("unit").alias("unit2"), F.col("dimension").alias("dimension2"), F.col("num").alias("num2"), F.col("den").alias("den2"))
    value = part.withColumn("v", (number(F.col("n")) + tail).cast("decimal(20,6)")).withColumn("v2", F.when(F.col("unit2") != "", number(F.col("n2"))).cast("decimal(20,6)"))
    joined = value.join(F.broadcast(table), "unit").join(F.broadcast(second), "unit2", "left")
    first_amount = (F.col("v") * F.col("num")).cast("decimal(34,8)") / F.col("den") + F.col("off")
    second_amount = F.when(F.col("dimension2") == F.col("dimension"), (F.col("v2") * F.col("num2")).cast("decimal(34,8)") / F.col("den2"))
    amounts = F.when(F.col("dimension2").isNull(), F.array(first_amount)).when(F.col("dimension2") == F.col("dimension"), F.array(first_amount + second_amount)).otherwise(F.array(first_amount, (F.col("v2") * F.col("num2")).cast("decimal(34,8)") / F.col("den2")))
    rows = joined.filter((F.col("dimension") != "time") | F.col("k").rlike(SHELF_LIFE))
    rows = rows.select("sample_id", "item_no", "dimension", F.explode(amounts).alias("amount"))
    return rows.withColumn("amount", F.round("amount", 0).cast("long")).filter("amount is not null")
