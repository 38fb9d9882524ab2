"""Texts of samples as items: one row per passage, review, parameter or OCR text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread


def _part(name: str, texts: Column, refs: Column | None) -> Column:
    struct = lambda x, i: F.struct(F.lit(name).alias("field_name"), i.cast("int").alias("item_no"), x.alias("text"), (F.lit(None).cast("string") if refs is None else F.get(refs, i)).alias("ref"))
    return F.coalesce(F.transform(texts, struct), F.array())


def items(samples: DataFrame, *fields: str) -> DataFrame:
    """sample_id, source, field_name, item_no, text, ref of the named fields.

    source is the domain of the attribute (the part of attribute_id before the first underscore),
    ref the review_id. NULL arrays give no rows, NULL texts none either. Other columns of samples
    are not looked at, so that extra columns cannot clash.
    """
    parts = {
        "passage": lambda: _part("passage", F.array(F.col("claim.passage")), None),
        "review": lambda: _part("review", F.col("reviews.text"), F.col("reviews.review_id")),
        "param": lambda: _part("param", F.col("evidence_params.raw_text"), None),
        "ocr": lambda: _part("ocr", F.col("evidence_ocr.raw_text"), None),
    }
    chosen = [parts[f]() for f in fields]
    arrays = spread(samples.select("sample_id", F.substring_index("attribute_id", "_", 1).alias("source"), (F.concat(*chosen) if len(chosen) > 1 else chosen[0]).alias("xs")))
    return arrays.select("sample_id", "source", F.explode("xs").alias("x")).select("sample_id", "source", "x.*").filter("text is not null")


def garbled_items(samples: DataFrame) -> DataFrame:
    """Judged stretches (see mojibake.garbled) of all passages and reviews."""
    from lodeweave.llm import mojibake

    return mojibake.garbled(items(samples, "passage", "review"))
