"""Unit vectors of the scalar functions."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodeweave.functions import evidence as E
from lodeweave.functions import looks
from lodeweave.functions import text as X
from lodeweave.functions import times as T
from lodeweave.functions import vectors as V


def value(spark, column, **given):
    row = spark.createDataFrame([Row(**given)], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in given.items()))
    return row.select(column.alias("x")).first().x


def test_normal_forms(spark):
    assert value(spark, X.normalized(F.col("s")), s="ＡＢ（c）- d，１") == "abcd1"
    assert value(spark, X.normalized(F.col("s")), s=None) == ""
    assert value(spark, X.compact(F.col("s")), s=" A b\tC ") == "abc"


def test_similarities(spark):
    sim = lambda a, b: value(spark, X.jaccard(X.bigrams(F.col("a")), X.bigrams(F.col("b"))), a=a, b=b)
    assert sim("abc", "abd") == 1 / 3
    assert sim("a", "a") == 1.0 and sim("", "") == 1.0 and sim("a", "") == 0.0
    assert value(spark, F.size(X.bigrams(F.col("a"), short_as_itself=False)), a="x") == 0
    assert value(spark, X.jaccard(X.characters(F.col("a")), X.characters(F.col("b"))), a="ab", b="bc") == 1 / 3


def test_free_phrase_and_slug(spark):
    for s in ("FREE::保质期", "free：保质期", "Free_ 保质期"):
        assert value(spark, X.free_phrase(F.col("s")), s=s) == "FREE::保质期"
    assert value(spark, X.free_phrase(F.col("s")), s="FREE::") is None
    assert value(spark, X.free_phrase(F.col("s")), s=" FOOD_1 ") == "FOOD_1"
    assert value(spark, X.slug(F.lit("GEN"), F.col("s")), s="，。") == "GEN_ATTR"


def test_hash_bucket_is_md5_mod_100(spark):
    assert value(spark, X.hash_bucket(F.col("s")), s="room") == 89


def test_data_path(spark):
    assert value(spark, X.data_path(F.col("s")), s="C:\\x\\data\\raw\\a.srt") == "data/raw/a.srt"
    assert value(spark, X.data_path(F.col("s")), s="raw/a.srt") == "raw/a.srt"


def test_times(spark):
    assert str(value(spark, T.parsed(F.col("s")), s="2025/1/10 9:20:49")) == "2025-01-10 09:20:49"
    for s in ("昨天", "--", "", None, "2025/13/45"):
        assert value(spark, T.parsed(F.col("s")), s=s) is None
    days = T.whole_days(T.parsed(F.col("a")), T.parsed(F.col("b")))
    assert value(spark, days, a="2025-01-01 23:00:00", b="2025-01-04 01:00:00") == 2
    assert value(spark, T.media_seconds(F.col("s")), s="01:02:03,500") == 3723.5
    assert value(spark, T.media_seconds(F.col("s")), s="junk") == 0.0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert abs(row.select(V.cosine(F.col("a"), F.col("b")).alias("x")).first().x - 0.96) < 1e-9
    assert len(row.select(V.pair_features(F.col("a"), F.col("b")).alias("x")).first().x) == 8


def test_bins(spark):
    assert [value(spark, E.count_bin(F.col("n")), n=float(n)) for n in (0, 1, 3, 4)] == ["src0", "src1", "src2_3", "src4p"]
    assert value(spark, E.confidence_bin(F.col("w"), F.col("c")), w=" ", c=0.5) == "medium"


def test_plain_looks(spark):
    assert value(spark, looks.plain(F.col("s")), s="１\u200b２ＫG\u00a0⽩Κ") == "12KG 白K"
    assert value(spark, looks.plain(F.col("s")), s=None) is None
