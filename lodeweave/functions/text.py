"""Text functions as native column expressions. NULL text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.looks import wide

# Fixed value: characters that key matching ignores.
IGNORED = r"[\s\-_/()（）·．。，,、:：;；'\"“”‘’!！?？]+"


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def normalized(c: Column) -> Column:
    """Matching form: plain width, lower case, without punctuation and white space."""
    table = wide() | {"！": "!", "（": "(", "）": ")", "，": ",", "：": ":", "；": ";", "？": "?", "～": "~", "　": " "}
    return F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), "".join(table), "".join(table.values()))), IGNORED, "")


def characters(c: Column) -> Column:
    """Set of the characters."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""))


def bigrams(c: Column, short_as_itself: bool = True) -> Column:
    """Set of two-character runs without white space; a shorter text is its own run, or has none."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    runs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) >= 2, F.array_distinct(runs)).otherwise(F.array(t) if short_as_itself else F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 if both are empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def mean_pairwise(sets: Column) -> Column:
    """Mean Jaccard similarity of all pairs of an array of sets; NULL with fewer than two."""
    n = F.size(sets)
    rows = F.transform(sets, lambda a, i: F.aggregate(F.slice(sets, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda s, b: s + jaccard(a, b)))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x) / F.nullif(n * (n - 1) / 2, F.lit(0.0))


def hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.coalesce(c, F.lit("")), t)))


def free_phrase(c: Column) -> Column:
    """FREE::phrase of the spellings FREE::x, FREE：x, FREE_x (any case); other ids unchanged, a bare prefix NULL."""
    found = F.trim(F.regexp_extract(c, r"(?i)^\s*FREE(?:::|：：|[:：_])[\s:：_]*(.*)$", 1))
    return F.when(c.rlike(r"(?i)^\s*FREE(?:::|：：|[:：_])"), F.when(found != "", F.concat(F.lit("FREE::"), found))).otherwise(F.trim(c))


def slug(prefix: Column, name: Column, length: int = 24) -> Column:
    """Identifier of a name: normalised, other than word characters as _, upper case, at most length."""
    base = F.regexp_replace(F.regexp_replace(normalized(name), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")
    return F.concat(prefix, F.lit("_"), F.coalesce(F.nullif(F.substring(F.upper(base), 1, length), F.lit("")), F.lit("ATTR")))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def hash_bucket(c: Column, modulus: int = 100) -> Column:
    """md5 of a string as a whole number modulo, digit by digit."""
    digits = F.split(F.md5(F.coalesce(c, F.lit(""))), "")
    step = lambda s, d: (s * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % modulus
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda s, d: step(s, d).cast("int"))


def data_path(c: Column) -> Column:
    """Path from its first data segment on, with plain slashes; without one unchanged."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(parts, "data").cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts)), "/")).otherwise(c)
