"""Queries of the relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import external as X
from lodeweave.plans import evidence, relational, schema
from lodeweave.session import table


def positional_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that the judge's decisions point to by position and align; all reviews are asked about."""
    s = table(spark, sf_dir, "samples").filter("size(reviews) > 0").select("sample_id", "reviews.review_id", F.coalesce("claim.passage", F.lit("")).alias("claim"), F.transform("reviews", lambda r: F.coalesce(r["text"], F.lit(""))).alias("comments"))
    asked = s.withColumn("request", F.to_json(F.struct("claim", "comments"))).withColumn("key", F.col("sample_id").cast("string"))
    said = X.call_many(asked, X.stub_judge).select(F.col("key").cast("long").alias("sample_id"), "response")
    rows = s.join(said, "sample_id").select("sample_id", F.explode(X.aligned_comments(F.col("response"), F.col("review_id"))).alias("j"))
    return rows.select("sample_id", "j.cid", F.col("j.comment").alias("review_id"))


PLANS = relational.PLANS | evidence.PLANS | schema.PLANS
QUERIES = {name: plan.run for name, plan in PLANS.items()} | {"positional_judgments": positional_judgments}
SQL = {name: plan.oracle() for name, plan in PLANS.items()} | {
    "positional_judgments": """with r as (select sample_id, coalesce(claim.passage, '') p, reviews, unnest(range(1, len(reviews) + 1)) i from samples), k as (select sample_id, i, reviews[i].review_id review_id, list_distinct(list_filter(string_split(p, ''), lambda z: z <> '')) a, list_distinct(list_filter(string_split(coalesce(reviews[i].text, ''), ''), lambda z: z <> '')) b from r)
 select sample_id, i::int cid, review_id from k where len(list_intersect(a, b)) >= 3"""
}
