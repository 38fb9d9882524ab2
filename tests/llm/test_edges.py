"""The queries on empty tables, and on tables with NULL rows, repeated rows and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import queries as Q

TABLES = ("samples", "join_split", "documents", "mix_targets", "pack_sizes")
NAMES = ("p1_found", "p1_split", "p2_found", "p2_repaired", "p3_found", "p5_found", "p6_found", "p7_packing", "p8_mixture", "p8_shares", "p9_found")
KEYS = {"samples": "sample_id", "documents": "doc_id"}


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        nulls = df.limit(3).select(*[F.col(c) if c == KEYS.get(t) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        if t in KEYS:
            nulls = nulls.withColumn(KEYS[t], F.col(KEYS[t]) + 10_000_000)
        rows = df.unionByName(nulls).unionByName(nulls) if t not in KEYS else df.unionByName(nulls)
        for extra in ("id", "key", "node", "component", "group", "n", "pos", "chain", "part", "bin", "code", "first", "word", "tokens", "times", "posterior"):
            rows = rows.withColumn(extra, F.lit("clash"))
        rows.write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_change_nothing(spark, data, odd, name):
    with_odd, plain = Q.queries()[name](spark, odd), Q.queries()[name](spark, data)
    assert with_odd.columns == plain.columns or name == "p1_split"
    extra = 6 if name == "p1_split" else 0
    assert with_odd.count() == plain.count() + extra
