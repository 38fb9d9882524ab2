"""Order-sensitive operators: folds within a row's array, and running positions.

A fold keeps its state in the accumulator of the ``aggregate`` higher-order function, over an
array sorted by a total order. The arrays are those of one group (a pair, a transcript).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as X
from lodeweave.functions import times as T


def adjacent_dedupe(texts: Column, least: float = 0.9) -> Column:
    """Texts without those whose character similarity to the last kept one reaches ``least``."""
    empty = F.array().cast("array<string>")
    keep = lambda kept, t: F.when((F.size(kept) > 0) & (X.jaccard(X.characters(F.try_element_at(kept, F.lit(-1))), X.characters(t)) >= least), kept).otherwise(F.concat(kept, F.array(t)))
    return F.aggregate(F.coalesce(texts, empty), empty, keep)


def even_sample(texts: Column, most: int = 600, target: int = 500, separator: str = "\n---\n") -> Column:
    """Evenly spread texts, so that the joined text comes down to about ``target``, if it exceeds ``most``."""
    n, total = F.size(texts), F.length(F.array_join(texts, separator))
    keep = F.greatest(F.lit(1), F.floor(n * (F.lit(float(target)) / total)).cast("int"))
    at = F.transform(F.sequence(F.lit(0), keep - 1), lambda i: F.least(n - 1, F.floor(i * (n / keep)).cast("int")))
    return F.when((total > most) & (n > 1), F.transform(F.array_distinct(at), lambda i: F.get(texts, i))).otherwise(texts)


def passages(claims: DataFrame, *keys: str) -> DataFrame:
    """Passage of each group: claims in order (``pos``), adjacent ones deduplicated, evenly sampled, joined."""
    texts = claims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("all"))
    kept = texts.withColumn("kept", adjacent_dedupe(F.col("all"))).withColumn("used", even_sample(F.col("kept")))
    return kept.select(*keys, F.size("all").alias("n_all"), F.size("kept").alias("n_kept"), F.size("used").alias("n_used"), F.array_join("used", "\n---\n").alias("passage"))


def strongest_mention(mentions: DataFrame, *keys: str, chunk: Column | None = None) -> DataFrame:
    """One mention per key by a fold in order (``pos``): the next replaces the kept one if it is
    explicit and that is not, or strong and that is not. This may lose explicitness; it is no maximum.

    What a row does depends on two marks of the kept one only. With ``chunk``, a column that never
    falls along ``pos``, the rows of a key and chunk are folded from each of the four states and from
    none at all, and the chunks' outcomes are composed: no array holds more than a chunk's rows or a key's
    chunks. A kept NULL mark is never improved upon, a NULL mark of the next row improves nothing.
    """
    item = F.struct("pos", "explicit_fact_hit", "mention_strength", "polarity", "evidence_span")
    rows = mentions.select(*keys, item.alias("item"), (F.lit(0) if chunk is None else chunk).alias("chunk"))
    kind = rows.schema["item"].dataType
    better = lambda a, b: (~a["explicit_fact_hit"] & b["explicit_fact_hit"]) | ((a["mention_strength"] != "strong") & (b["mention_strength"] == "strong"))
    step = lambda a, b: F.when(better(a, b), b).otherwise(a)
    empty = F.lit(None).cast("string")
    given = lambda e, s: F.struct(*[(F.lit(e) if n == "explicit_fact_hit" else F.lit(s) if n == "mention_strength" else empty).cast(kind[n].dataType).alias(n) if n != "pos" else F.lit(None).cast(kind[n].dataType).alias(n) for n in kind.names])
    state = lambda r: F.coalesce(r["explicit_fact_hit"], F.lit(True)).cast("int") * 2 + F.coalesce(r["mention_strength"] == "strong", F.lit(True)).cast("int")
    inside = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("item")).alias("all"))
    first = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", 0), step)
    after = F.array(*[F.aggregate("all", given(e, s), step) for e in (False, True) for s in ("", "strong")])
    chunks = inside.select(*keys, F.struct("chunk", first.alias("first"), after.alias("after")).alias("c"))
    whole = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list("c"), lambda x, y: F.when(x["chunk"] < y["chunk"], -1).otherwise(1)).alias("cs"))

    def follow(kept: Column, c: Column) -> Column:
        next_ = F.get(c["after"], state(kept))
        return F.when(next_["pos"].isNull(), kept).otherwise(next_)

    kept = F.aggregate(F.slice("cs", 2, F.greatest(F.size("cs") - 1, F.lit(0))), F.get("cs", 0)["first"], follow)
    return whole.select(*keys, kept.alias("__k")).select(*keys, "__k.explicit_fact_hit", "__k.mention_strength", "__k.polarity", "__k.evidence_span")


# Fixed value: a subtitle's time line and the text line after it.
CUE = r"(\d\d:\d\d:\d\d[,.]\d{3}) --> (\d\d:\d\d:\d\d[,.]\d{3})[^\n]*\n([^\n]*)"


def cues(transcripts: DataFrame) -> DataFrame:
    """Subtitle cues of transcripts (doc_id, text): number, times, text, character span in the joined text."""
    rows = transcripts.filter(F.col("text").contains("-->")).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(CUE), F.lit(0))).alias("idx", "block"))
    part = lambda i: F.regexp_extract("block", CUE, i)
    rows = rows.select("doc_id", "idx", part(1).alias("start_ts"), part(2).alias("end_ts"), F.trim(part(3)).alias("text"))
    end = F.sum(F.length("text")).over(W.partitionBy("doc_id").orderBy("idx"))
    return rows.withColumns({"start_s": T.media_seconds(F.col("start_ts")), "end_s": T.media_seconds(F.col("end_ts")), "char_end": end.cast("int")}).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int"))


def chunk_ranges(spans: Column, budget: int) -> Column:
    """Ranges of whole spans (char_start, char_end): a new one begins where the budget would be exceeded."""
    start = F.struct(F.array().cast("array<struct<a:int,z:int>>").alias("done"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("z"))

    def step(s, x):
        over = (s["z"] > s["a"]) & (x["char_end"] - s["a"] > budget)
        fresh = F.struct(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["z"].alias("z")))).alias("done"), x["char_start"].alias("a"), x["char_end"].alias("z"))
        more = F.struct(s["done"].alias("done"), F.coalesce(s["a"], x["char_start"]).alias("a"), x["char_end"].alias("z"))
        return F.when(F.coalesce(over, F.lit(False)), fresh).otherwise(more)

    return F.aggregate(spans, start, step, lambda s: F.when(s["z"] > s["a"], F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["z"].alias("z"))))).otherwise(s["done"]))
