"""Codes and bins of evidence as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_total(counts: Column) -> Column:
    """Number of pieces of evidence of a struct of counts."""
    return sum((F.coalesce(counts[k], F.lit(0)) for k in ("params", "ocr", "vlm")), F.lit(0))


def combination(params: Column, ocr: Column, vlm: Column) -> Column:
    """Letters P, O and V of the kinds of evidence present, or none."""
    part = lambda c, s: F.when(F.size(F.coalesce(c, F.array())) > 0, s).otherwise("")
    return F.coalesce(F.nullif(F.concat(part(params, "P"), part(ocr, "O"), part(vlm, "V")), F.lit("")), F.lit("none"))


def confidence_word(coverage: Column) -> Column:
    return F.when(coverage == 3, "high").when(coverage == 2, "medium").when(coverage == 1, "low").otherwise("absent")


def confidence_score(word: Column) -> Column:
    return F.when(word == "high", 3).when(word == "medium", 2).when(word == "low", 1).otherwise(0)


def confidence_bin(word: Column, c: Column) -> Column:
    """Given word, else the bin of the weight."""
    by_weight = F.when(c < 0.20, "absent").when(c < 0.40, "low").when(c < 0.70, "medium").otherwise("high")
    return F.coalesce(F.nullif(F.trim(word), F.lit("")), by_weight)


def count_bin(n: Column, fine: bool = False) -> Column:
    """Bin of a number of sources: four names, or five numbers from 0 to 4."""
    if fine:
        return F.when(n <= 0, 0).when(n == 1, 1).when(n <= 3, 2).when(n <= 8, 3).otherwise(4)
    return F.when(n <= 0, "src0").when(n == 1, "src1").when(n <= 3, "src2_3").otherwise("src4p")


def has_claim(claim: Column) -> Column:
    """Flag set, and a segment or a passage."""
    return F.coalesce(claim["has_claim_srt"], F.lit(False)) & ((F.size(F.coalesce(claim["segments"], F.array())) > 0) | (F.coalesce(claim["passage"], F.lit("")) != ""))
