"""Calls of external models as operators: injected clients, error rows, a keyed response cache.

A client is a picklable callable from a request text to a response text. The deterministic stubs
stand for models that this container has not; what surrounds the calls (keys, cache, parsing,
validation, error rows) is the operator.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodeweave.functions import vectors as V
from lodeweave.sources.records import exists


def content_key(*columns):
    """SHA-256 of the request's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def call_many(requests: DataFrame, client: Callable[[str], str], retries: int = 5, wait: float = 0.0, concurrency: int = 8) -> DataFrame:
    """UD1, UD2, UD9: key, response, error of each request (key, request): a failure becomes an error row.

    Each task has up to ``concurrency`` calls under way and keeps their order. A call is tried up to
    ``retries`` times with pauses of wait * 2^n seconds, 30 at most.
    """

    def call(request: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(retries):
            try:
                return client(request), None
            except Exception as x:  # noqa: BLE001
                error = f"{type(x).__name__}: {x}"
                if wait:
                    time.sleep(min(30.0, wait * 2**n))
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in batches:
                said = list(pool.map(call, frame["request"]))
                yield pd.DataFrame({"key": frame["key"], "response": [r for r, _ in said], "error": [e for _, e in said]})

    return requests.select("key", "request").mapInPandas(run, "key string, response string, error string")


def risk_scores(rows: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """UD9: key, score, decision of the model's JSON answers; a missing or unreadable score is 0.5, a decision 0; scores are kept within 0 and 1."""
    said = call_many(rows, client)
    answer = F.from_json("response", "score double, decision int")
    score = F.coalesce(F.nanvl(answer["score"], F.lit(0.5)), F.lit(0.5))
    return said.select("key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.coalesce(answer["decision"], F.lit(0)).alias("decision"))


def reachable(spark: SparkSession, client: Callable[[str], str]) -> DataFrame:
    """UD10: ok and error of one call from an executor, so that a client that works on the driver only is found out."""
    said = call_many(spark.createDataFrame([("ping", "ping")], "key string, request string"), client, retries=1)
    return said.select(F.col("error").isNull().alias("ok"), "error")


def cached_calls(requests: DataFrame, client: Callable[[str], str], path: str) -> DataFrame:
    """Responses from the cache at the path; only requests it lacks are sent, and kept for later
    in folders by the first two characters of the key."""
    spark = requests.sparkSession
    distinct = requests.select("key", "request").dropDuplicates(["key"])
    if exists(spark, path):
        distinct = distinct.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    call_many(distinct, client).filter("error is null").withColumn("folder", F.substring("key", 1, 2)).write.mode("append").partitionBy("folder").parquet(path)
    return requests.join(spark.read.parquet(path).select("key", "response"), "key", "left")


def embedded(texts: DataFrame, client: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """The rows with ``embedding``, the client's vector of the text brought to unit length. The client gets a batch of texts;
    a NULL text is the empty one, a vector of zeros stays."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(client(s.fillna("").tolist()))

    raw = texts.withColumn("__v", F.pandas_udf(embed, "array<double>")(F.col(text)))
    return raw.withColumn("embedding", V.scaled(F.col("__v"), 1 / F.greatest(V.norm(F.col("__v")), F.lit(1e-12)))).drop("__v")


def stub_embedder(texts: list[str]) -> list[list[float]]:
    """Counts of a text's characters by the first digit of their md5."""
    from hashlib import md5

    out = []
    for t in texts:
        v = [0.0] * 16
        for c in t:
            v[int(md5(c.encode()).hexdigest()[0], 16)] += 1.0
        out.append(v)
    return out


def stub_classifier(request: str) -> str:
    """UD4: class of a request by its words, other by default."""
    return next((c for c, words in (("size", ("偏大", "偏小", "尺码")), ("service", ("客服", "物流", "快递")), ("quality", ("起球", "开了口", "坏了"))) if any(w in request for w in words)), "other")


def stub_judge(request: str) -> str:
    """UD8: decisions about numbered comments as JSON: those that share a word with the claim."""
    data = json.loads(request)
    claim = set(data["claim"])
    return json.dumps([{"cid": i + 1, "aligned": int(len(claim & set(t)) >= 3)} for i, t in enumerate(data["comments"])])


def stub_risk(request: str) -> str:
    """UD9: a risk from the request's length; every fifth answer lacks its score, every seventh is no JSON."""
    n = len(request)
    return "?" if n % 7 == 0 else json.dumps({"decision": n % 2} | ({} if n % 5 == 0 else {"score": n / 100}))


@udtf(returnType="aspect string, position int")
class Aspects:
    """UD5 to UD7: one text to many rows, a named aspect and where it stands."""

    def eval(self, text: str):
        for aspect, words in (("size", ("偏大", "偏小", "尺码")), ("service", ("客服", "物流")), ("smell", ("味道", "异味")), ("price", ("块", "性价比"))):
            for w in words:
                if text and (at := text.find(w)) >= 0:
                    yield aspect, at
                    break


def decoded_alignment(response, n):
    """0/1 vector of n comments from the decisions; bad ids are ignored, later ones win, a failure gives zeros."""
    parsed = F.coalesce(F.from_json(response, "array<struct<cid:int,aligned:int>>"), F.array().cast("array<struct<cid:int,aligned:int>>"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(F.filter(parsed, lambda d: d["cid"] == i), F.lit(-1))["aligned"], F.lit(0)))


def aligned_comments(response, comments):
    """Cid and comment of each decision that aligns; cids count from 1, those out of range or not whole numbers are dropped."""
    parsed = F.coalesce(F.from_json(response, "array<struct<cid:string,aligned:int>>"), F.array().cast("array<struct<cid:string,aligned:int>>"))
    whole = F.transform(parsed, lambda d: F.struct(d["cid"].try_cast("int").alias("cid"), d["aligned"].alias("aligned")))
    kept = F.filter(whole, lambda d: (d["cid"] >= 1) & (d["cid"] <= F.size(comments)) & (d["aligned"] != 0))
    return F.transform(kept, lambda d: F.struct(d["cid"].alias("cid"), F.get(comments, d["cid"] - 1).alias("comment")))
