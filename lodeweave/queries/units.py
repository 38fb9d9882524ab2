"""Queries of problem 4: quantities in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.quantities import quantities
from lodeweave.session import table


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").select("sample_id", F.substring_index("attribute_id", "_", 1).alias("source"), F.posexplode("evidence_params").alias("item_no", "x")).select("sample_id", "source", "item_no", "x.param_key", "x.raw_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity of the parameters, temperatures aside, in thousandths of its common unit."""
    return quantities(_params(spark, sf_dir)).filter("dimension <> 'temperature'").select("sample_id", "item_no", "amount").distinct()


def p4_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, items, least and largest amount of each dimension."""
    rows = quantities(_params(spark, sf_dir)).distinct()
    return rows.groupBy("dimension").agg(F.count("*").alias("quantities"), F.countDistinct("sample_id", "item_no").alias("items"), F.min("amount").alias("least"), F.max("amount").alias("largest"))


QUERIES = {f.__name__: f for f in (p4_found, p4_dimensions)}
SQL: dict[str, str] = {}
