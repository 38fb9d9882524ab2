"""Queries of the problems in this subpackage, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.llm import items as I
from lodeweave.llm import language, lookalike, mixture, mojibake, near, neardup, overlap, packing, splits, tokens
from lodeweave.operators.components import components
from lodeweave.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of groups whose samples carry several splits."""
    return splits.broken(table(spark, sf_dir, "join_split"), table(spark, sf_dir, "samples"))


def p1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pair records with the split of their group."""
    records = table(spark, sf_dir, "join_split").select("pair_id", "product_id", "room_id", "attribute_id", "built_ts")
    return splits.assigned(records)


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups of each split, and the share of the records."""
    rows = p1_split(spark, sf_dir).groupBy("assigned_split").agg(F.count("*").alias("records"), F.countDistinct("group_key").alias("groups"))
    return rows.withColumn("share", F.col("records") / F.sum("records").over(W.partitionBy()))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and reviews with a garbled stretch."""
    judged = I.garbled_items(table(spark, sf_dir, "samples"))
    return judged.filter("posterior >= 0.5").select("sample_id", "field_name", "item_no").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled passages and reviews with the text restored where possible."""
    return mojibake.repaired(I.garbled_items(table(spark, sf_dir, "samples")))


def _reduced(samples: DataFrame, *fields: str) -> DataFrame:
    """Items whose reduced text is long enough, with that text."""
    long = I.items(samples, *fields).filter(F.length("text") >= near.MIN_CHARS)
    return long.withColumn("text", near.reduced(F.col("text"))).filter(F.length("text") >= near.MIN_CHARS)


def _consistent(samples: DataFrame) -> DataFrame:
    """Reviews, parameters and OCR texts that are not in their consistent form, garbled reviews left out."""
    bad = I.garbled_items(samples).filter("posterior >= 0.5").select("sample_id", "field_name", "item_no").distinct()
    return lookalike.rewritten(I.items(samples, "review", "param", "ocr")).join(bad, ["sample_id", "field_name", "item_no"], "left_anti")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews, parameters and OCR texts with a character that stands for a plain one of the same look."""
    return _consistent(table(spark, sf_dir, "samples")).select("sample_id", "field_name", "item_no").distinct()


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those texts with their consistent form."""
    return _consistent(table(spark, sf_dir, "samples")).select("sample_id", "field_name", "item_no", F.col("clean").alias("consistent_text"))


def _train_eval(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = samples.filter("split in ('train', 'val', 'test')")
    return _reduced(rows.filter("split = 'train'"), "passage", "ocr"), _reduced(rows.filter("split <> 'train'"), "passage", "ocr")


def _overlap_pairs(samples: DataFrame) -> DataFrame:
    """train_id, eval_id, field_name, and the near-same texts' eval_chars, similarity and spans; garbled passages left out."""
    train, evaluation = _train_eval(samples)
    pairs = cut(overlap.overlaps(train, evaluation))
    bad = I.garbled_items(samples).filter("posterior >= 0.5 and field_name = 'passage'").select("sample_id", "field_name")
    holders = lambda side, key, name: side.select("field_name", overlap.text_key("text").alias(key), F.col("sample_id")).join(bad, ["sample_id", "field_name"], "left_anti").withColumnRenamed("sample_id", name).distinct()
    return pairs.join(holders(train, "train_key", "train_id"), ["field_name", "train_key"]).join(holders(evaluation, "eval_key", "eval_id"), ["field_name", "eval_key"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and an evaluation row with near-same passages or OCR texts."""
    rows = _overlap_pairs(table(spark, sf_dir, "samples"))
    return rows.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"), "field_name").distinct()


def _covered(pairs: DataFrame) -> DataFrame:
    """eval_id, field_name, train_rows, similarity (the highest), coverage: intervals of all training
    rows merged; of several OCR texts of a row the one covered most counts."""
    merged = overlap.merged(pairs).groupBy("eval_id", "field_name").agg(F.max("coverage").alias("coverage"))
    met = pairs.groupBy("eval_id", "field_name").agg(F.countDistinct("train_id").alias("train_rows"), F.max("similarity").alias("similarity"))
    return met.join(merged, ["eval_id", "field_name"])


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each evaluation row by the training rows, with their number and the highest similarity."""
    return _covered(cut(_overlap_pairs(table(spark, sf_dir, "samples")))).select("eval_id", "field_name", "train_rows", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and room of the evaluation row: rows, training rows met, pairs, mean coverage."""
    samples = table(spark, sf_dir, "samples")
    rooms = table(spark, sf_dir, "join_split").filter("pair_id is not null").groupBy("pair_id").agg(F.min("room_id").alias("room_id"))
    facts = cut(samples.select(F.col("sample_id").alias("eval_id"), "split", "pair_id").join(rooms, "pair_id", "left").select("eval_id", "split", F.col("room_id")))
    pairs = cut(_overlap_pairs(samples))
    place = ["split", "room_id", "field_name"]
    rows = pairs.select("train_id", "eval_id", "field_name").distinct().join(facts, "eval_id")
    met = rows.groupBy(*place).agg(F.countDistinct("eval_id").alias("eval_rows"), F.countDistinct("train_id").alias("train_rows"), F.count("*").alias("pairs"))
    share = _covered(pairs).join(facts, "eval_id").groupBy(*place).agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in place]
    return met.alias("m").join(share.alias("s"), same).select("m.*", "mean_coverage")


def _review_classes(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews that are not garbled with the key of their reduced text, and near-same keys (ka, kb)."""
    reviews = _reduced(samples, "review").filter("ref is not null")
    bad = I.garbled_items(samples).filter("posterior >= 0.5 and field_name = 'review'").select(F.col("ref").alias("review_id")).distinct()
    owned = reviews.select(F.col("ref").alias("review_id"), F.md5("text").alias("key")).repartition("review_id")  # one shuffle serves the distinct and the join
    members = cut(owned.distinct().join(bad, "review_id", "left_anti"))
    return members, neardup.near_pairs(neardup.classes(reviews)).select(F.md5("a").alias("ka"), F.md5("b").alias("kb"))


def _review_pairs(samples: DataFrame) -> DataFrame:
    """review_id_a, review_id_b of near-same reviews, garbled ones left out."""
    members, near_same = _review_classes(samples)
    by_key = members.select("key", "review_id").repartition("key")  # the same shuffle for all four uses
    of = lambda n: by_key.select(F.col("key").alias(f"k{n}"), F.col("review_id").alias(f"r{n}"))
    apart = near_same.join(of("a"), "ka").join(of("b"), "kb").select("ra", "rb")
    equal = by_key.alias("x").join(by_key.alias("y"), "key").filter("x.review_id < y.review_id").select(F.col("x.review_id").alias("ra"), F.col("y.review_id").alias("rb"))
    return apart.unionByName(equal).filter("ra <> rb").select(F.least("ra", "rb").alias("review_id_a"), F.greatest("ra", "rb").alias("review_id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different reviews with near-same texts."""
    return _review_pairs(table(spark, sf_dir, "samples"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review with a near-same one: its connected group and its number of links; copies are not expanded into pairs."""
    members, near_same = _review_classes(table(spark, sf_dir, "samples"))
    sizes = cut(members.groupBy("key").agg(F.countDistinct("review_id").alias("size")))
    real = sizes.select("key")
    links = cut(near_same.join(real.withColumnRenamed("key", "ka"), "ka", "left_semi").join(real.withColumnRenamed("key", "kb"), "kb", "left_semi").select("ka", "kb"))
    both = links.select(F.col("ka").alias("key"), F.col("kb").alias("other")).unionByName(links.select(F.col("kb").alias("key"), F.col("ka").alias("other")))
    linked = both.join(sizes.select(F.col("key").alias("other"), F.col("size").alias("there")), "other").groupBy("key").agg(F.sum("there").alias("linked"))
    group = components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b"))).select(F.col("node").alias("key"), "component")
    rows = members.join(sizes, "key").join(linked, "key", "left").join(group, "key", "left")
    out = rows.select("review_id", F.coalesce("component", "key").alias("group_key"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return out.filter("n_links > 0")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.sized(table(spark, sf_dir, "documents"), "doc_id"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document (or piece of one above the capacity) for each capacity."""
    return packing.packed(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, certified least number and filling of each capacity."""
    sizes, packs = _sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    return packing.report(packing.packed(sizes, packs), sizes, packs)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    names = [r[0] for r in targets.select("source").filter("source is not null").distinct().collect()]  # a fixed table
    wanted = table(spark, sf_dir, "documents").filter(F.col("source").isin(names) if names else F.lit(False))
    return mixture.mixed(tokens.sized(wanted, "doc_id", "source", "lang"), targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in which a document has a whole sentence and which its label does not name."""
    return language.unnamed(language.parts(table(spark, sf_dir, "documents")))


def p9_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each document in one language, with their confidence."""
    return language.parts(table(spark, sf_dir, "documents"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of each document, with its share and confidence."""
    return language.main_language(language.parts(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_split, p1_shares, p2_found, p2_repaired, p3_found, p3_consistent, p5_found, p5_coverage, p5_report, p6_found, p6_groups, p7_packing, p7_report, p8_mixture, p8_shares, p9_found, p9_parts, p9_documents)}


_WIDE = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000]))
_HALF = "".join(map(chr, [*range(0x21, 0x7F), 0x20])).replace("'", "''")
_GROUPS = f"""rec as (select pair_id, product_id, room_id, lower(regexp_replace(translate(room_id, '{_WIDE}', '{_HALF}'), '[\\s\u00a0\u2000-\u200b]+', '', 'g')) r0 from join_split), keyed as (select *, case when r0 not in ('', 'unknown') then r0 end room from rec),
 edge as (select distinct 'p:' || product_id a, 'r:' || room b from keyed where product_id is not null and room is not null), link as (select a, b from edge union all select b, a from edge), node as (select distinct 'p:' || product_id n from keyed where product_id is not null union select b from edge),
 reach as (select n, n root from node union select l.b, reach.root from reach join link l on reach.n = l.a), grp as (select n, min(root) g from reach group by n)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express on whole tables: groups by recursive reachability, the
    greedy assignment by a recursive walk over the groups."""
    return {
        "p1_found": f"""with recursive {_GROUPS}, marks as (select grp.g, s.split from samples s join keyed k on s.pair_id = k.pair_id join grp on grp.n = 'p:' || k.product_id where s.split is not null), bad as (select g from marks group by g having count(distinct split) > 1) select substr(n, 3) product_id from grp join bad using (g) where n like 'p:%'""",
        "p1_shares": f"""with recursive {_GROUPS}, rows_ as (select coalesce(x.g, y.g, 'r:' || room, '') g from keyed k left join grp x on x.n = 'p:' || k.product_id left join grp y on y.n = 'r:' || k.room), size as (select g, count(*) n from rows_ group by g), turn as (select n, row_number() over (order by n desc, g) i, (sum(n) over ())::bigint t from size),
 walk as (select 0::bigint i, 0::bigint n, ''::varchar s, 0::bigint a, 0::bigint b, 0::bigint c union all select i, n, s, a + case when s = 'train' then n else 0 end, b + case when s = 'val' then n else 0 end, c + case when s = 'test' then n else 0 end from (select turn.i, turn.n, a, b, c, case when 7 * t - 10 * a >= greatest(t - 10 * b, 2 * t - 10 * c) then 'train' when t - 10 * b >= 2 * t - 10 * c then 'val' else 'test' end s from walk join turn on turn.i = walk.i + 1))
 select s assigned_split, sum(n)::bigint records, count(*) "groups", sum(n) / (select count(*) from keyed) share from walk where i > 0 group by s""",
    }
