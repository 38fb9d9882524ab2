"""Sorted selections, prefixes, folds and alignments; global orders by range partitions, ranks of groups by hash blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.operators import assign as A
from lodeweave.operators import places as P
from lodeweave.session import cut, table


def _hash(c: str):
    return F.md5(F.col(c).cast("string"))


def _rooms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "join_split").filter("pair_id is not null").groupBy("pair_id").agg(F.min("room_id").alias("room_id"), F.min("category").alias("category"))


def hq_quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives with a claim, negatives bucket by bucket, each by weight and pair, up to 1.5 times
    as many (rounded half to even), with their place by room and pair. Only three named buckets qualify."""
    s = table(spark, sf_dir, "samples").filter("y is not null and coalesce(claim.passage, '') <> ''")
    s = cut(s.select("sample_id", "pair_id", "y", "c", F.expr("case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 end").alias("b")).join(_rooms(spark, sf_dir), "pair_id", "left").drop("category"))
    target = s.agg(F.bround(F.coalesce(F.sum("y"), F.lit(0)) * 1.5, 0).alias("most"))
    negatives = P.numbered(s.filter("y = 0 and b is not null"), "b", F.desc_nulls_last("c"), "pair_id", "sample_id", name="turn")
    chosen = negatives.join(F.broadcast(target), F.col("turn") <= F.col("most")).select(*s.columns).unionByName(s.filter("y = 1"))
    return P.numbered(chosen, F.asc_nulls_first("room_id"), "pair_id", "sample_id").select("sample_id", "pair_id", "room_id", "y", "c", "place")


def injection_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of the training rows, in hash order, at fifths."""
    rows = table(spark, sf_dir, "samples").filter("split = 'train'").select("sample_id", _hash("sample_id").alias("h"))
    placed = P.numbered(rows, "h", "sample_id")
    n = placed.agg(F.count("*").alias("n"))
    grid = placed.join(F.broadcast(n)).select("sample_id", F.explode(F.array(*map(F.lit, (0, 20, 40, 60, 80, 100)))).alias("f"), "place", "n")
    return grid.filter("place <= round(f * n / 100.0)").groupBy("f").agg(F.count("*").alias("n_rows"), F.sum("sample_id").alias("id_sum"))


def positional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bundles of results aligned with the test rows: one by pair id, one without ids by position,
    which is used only if it has as many rows."""
    s = table(spark, sf_dir, "samples")
    rows = P.numbered(s.filter("split = 'test'").select("sample_id", "pair_id"), "sample_id", name="pos")
    by_id = s.filter("split is null or split <> 'test'").groupBy("pair_id").agg(F.max("sample_id").alias("other_id"))
    scores = P.numbered(s.filter("split = 'test'").select("loaded_ts", F.col("sample_id").alias("sid"), F.col("c").alias("score")), "loaded_ts", "sid", name="pos").select("pos", "score")
    longer = P.numbered(s.filter("split = 'val'").select(F.col("sample_id").alias("sid"), F.col("c").alias("val_score")), "sid", name="pos").select("pos", "val_score")
    sizes = rows.agg(F.count("*").alias("n")).join(F.broadcast(longer.agg(F.count("*").alias("m"))))
    out = rows.join(by_id, "pair_id", "left").join(scores, "pos", "left").join(longer, "pos", "left").join(F.broadcast(sizes))
    return out.select("pos", "sample_id", "other_id", "score", F.when(F.col("n") == F.col("m"), F.col("val_score")).alias("val_score"))


def _volumes(spark, sf_dir) -> DataFrame:
    """room_id, volume: reviews plus one of all labelled rows of the room."""
    s = table(spark, sf_dir, "samples").filter("y is not null").select("pair_id", F.coalesce(F.size("reviews"), F.lit(0)).alias("n"))
    return s.join(_rooms(spark, sf_dir), "pair_id").filter("room_id <> ''").groupBy("room_id").agg(F.sum(F.col("n") + 1).alias("volume"))


def _holdout(spark, sf_dir) -> DataFrame:
    ranked = P.numbered(_volumes(spark, sf_dir), F.desc("volume"), "room_id", name="i").withColumn("i", F.col("i") - 1)
    last = ranked.agg((F.count("*") - 1).alias("last"))
    at = last.select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("g"), "last").select(F.bround(F.col("g") * F.col("last") / 19.0, 0).cast("long").alias("i")).distinct()
    return ranked.join(F.broadcast(at), "i")


def holdout_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rooms spread evenly over the ranking by volume."""
    return _holdout(spark, sf_dir).select("room_id", "volume", "i")


def _fold_parts(rows: DataFrame) -> DataFrame:
    """fold, sample_id, held to parts: held rows are the test part; of the others, in hash order, the first
    max(50, a tenth) are the validation part. Ranks go through 4,096 blocks of the hash."""
    rest = rows.filter("not held").withColumn("h", F.concat(_hash("sample_id"), F.lpad(F.col("sample_id").cast("string"), 20, "0"))).withColumn("block", F.substring("h", 1, 3))
    blocks = cut(rest.groupBy("fold", "block").agg(F.count("*").alias("m")))
    before = blocks.select("fold", "block", (F.sum("m").over(W.partitionBy("fold").orderBy("block")) - F.col("m")).alias("before"))
    most = blocks.groupBy("fold").agg(F.greatest(F.lit(50), F.floor(F.sum("m") / 10)).alias("most"))
    ranked = rest.join(before, ["fold", "block"]).join(most, "fold").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("fold", "block").orderBy("h")))
    return ranked.select("fold", "sample_id", F.when(F.col("rank") <= F.col("most"), "val").otherwise("train").alias("part")).unionByName(rows.filter("held").select("fold", "sample_id", F.lit("test").alias("part")))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("sample_id").alias("id_sum"))


def category_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category the split that holds it out."""
    rows = table(spark, sf_dir, "samples").select("sample_id", "pair_id").join(_rooms(spark, sf_dir), "pair_id").select("sample_id", "category")
    names = table(spark, sf_dir, "category_schema").select("category").distinct().agg(F.array_sort(F.collect_set("category")).alias("names"))  # a fixed table
    folds = rows.join(F.broadcast(names)).select("sample_id", "category", F.explode("names").alias("fold"))
    return _summed(_fold_parts(folds.select("fold", "sample_id", F.coalesce(F.col("category") == F.col("fold"), F.lit(False)).alias("held"))))


def room_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split that holds out the twenty rooms of ``holdout_rooms``."""
    held = _holdout(spark, sf_dir).select("room_id", F.lit(True).alias("held"))
    rows = table(spark, sf_dir, "samples").select("sample_id", "pair_id").join(_rooms(spark, sf_dir), "pair_id", "left").join(F.broadcast(held), "room_id", "left")
    return _summed(_fold_parts(rows.select(F.lit("rooms").alias("fold"), "sample_id", F.coalesce("held", F.lit(False)).alias("held"))))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, ST5: rows whose earliest review is late are the test part; early rows and the background
    between the cutoffs or without a time are for training and validation."""
    times = "transform(reviews, r -> coalesce(try_to_timestamp(r.review_time, 'yyyy/M/d H:m:s'), try_to_timestamp(r.review_time, 'yyyy-M-d H:m:s'), try_to_timestamp(r.review_time, 'yyyy/M/d')))"
    rows = table(spark, sf_dir, "samples").select("sample_id", F.expr(f"array_min({times})").alias("t"))
    late = F.coalesce(F.col("t") >= F.lit("2025-02-15").cast("timestamp"), F.lit(False))
    stage = F.when(F.col("t") < F.lit("2025-01-01").cast("timestamp"), "early").when(late, "late").otherwise("background")
    parts = _fold_parts(rows.select(F.lit("time").alias("fold"), "sample_id", late.alias("held")))
    return parts.join(rows.select("sample_id", stage.alias("stage")), "sample_id").select("sample_id", "part", "stage")


def stratified_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each class in hash order, ranked through 4,096 blocks of the hash."""
    rows = table(spark, sf_dir, "samples").filter("y is not null").select("sample_id", "y", F.concat(_hash("sample_id"), F.lpad(F.col("sample_id").cast("string"), 20, "0")).alias("h")).withColumn("block", F.substring("h", 1, 3))
    blocks = cut(rows.groupBy("y", "block").agg(F.count("*").alias("m")))
    before = blocks.select("y", "block", (F.sum("m").over(W.partitionBy("y").orderBy("block")) - F.col("m")).alias("before"))
    half = blocks.groupBy("y").agg(F.floor(F.sum("m") / 2).alias("half"))
    ranked = rows.join(before, ["y", "block"]).join(half, "y").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("y", "block").orderBy("h")))
    return ranked.filter("rank <= half").select("sample_id", "y")


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a hundred validation rows, half of each class in hash order; fewer rows are all kept."""
    val = cut(table(spark, sf_dir, "samples").filter("split = 'val' and y is not null").select("sample_id", "y", F.concat(_hash("sample_id"), F.lpad(F.col("sample_id").cast("string"), 20, "0")).alias("h")))
    many = val.agg((F.count("*") > 100).alias("many"))
    ranked = P.numbered(val.filter("y = 1"), "h").unionByName(P.numbered(val.filter("y <> 1"), "h"))
    return ranked.join(F.broadcast(many)).filter("not many or place <= 50").select("sample_id", "y")


def _groups(spark, sf_dir) -> DataFrame:
    j = table(spark, sf_dir, "join_split")
    return j.select(F.coalesce(F.nullif("room_id", F.lit("")), "product_id", "pair_id").alias("room"), F.coalesce("y", F.lit(0)).alias("y"))


def room_split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms (else products, else pairs), the largest first, to the split that leaves rows and positives best balanced."""
    return A.balanced_splits(_groups(spark, sf_dir), "room", "y").select(F.col("room").alias("room_id"), "n", "pos", "split")


def room_split_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms (else products, else pairs), the largest first, to the split that lacks most rows."""
    return A.deficit_splits(_groups(spark, sf_dir), "room").select(F.col("room").alias("room_id"), "n", "split")


QUERIES = {f.__name__: f for f in (hq_quota_fill, injection_prefixes, positional_align, holdout_rooms, category_folds, room_folds, time_split, stratified_half, capped_sample, room_split_greedy, room_split_deficit)}

_R = "r as (select pair_id, min(room_id) room_id, min(category) category from join_split where pair_id is not null group by 1)"
_VOL = f"{_R}, v as (select room_id, sum(coalesce(len(reviews), 0) + 1) volume from samples s join r on s.pair_id = r.pair_id where s.y is not null and room_id <> '' group by 1), o as (select *, row_number() over (order by volume desc, room_id) - 1 i, count(*) over () n from v), held as (select distinct o.* from o, unnest(range(0, 20)) t(g) where i = round_even(g * (n - 1) / 19.0, 0))"
_H = "md5(sample_id::varchar) || lpad(sample_id::varchar, 20, '0')"
_PARTS = f"u as (select *, row_number() over (partition by fold order by {_H}) k, count(*) over (partition by fold) m from rows_ where not held), parts as (select fold, sample_id, case when k <= greatest(50, m // 10) then 'val' else 'train' end part from u union all select fold, sample_id, 'test' from rows_ where held)"
_SUM = "select fold, part, count(*) n, sum(sample_id)::bigint id_sum from parts group by 1, 2"
_TS = "coalesce(try_strptime(x.review_time, '%Y/%m/%d %H:%M:%S'), try_strptime(x.review_time, '%Y-%m-%d %H:%M:%S'), try_strptime(x.review_time, '%Y/%m/%d'))"
_G = "g as (select coalesce(nullif(room_id, ''), product_id, pair_id) room, count(*) n, sum(coalesce(y, 0)) pos from join_split group by 1)"
_ERR = lambda k: " + ".join(f"power(({s}n + {f'k.n' if s == k else '0'} - {w} * tn) / greatest(1, {w} * tn), 2) + 2 * power(({s}p + {f'k.pos' if s == k else '0'} - {w} * tp) / greatest(1, {w} * tp), 2)" for s, w in (("a", "0.7"), ("b", "0.1"), ("c", "0.2")))
SQL = {
    "hq_quota_fill": f"with {_R}, s as (select sample_id, s.pair_id, room_id, y, c, case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 end b from samples s left join r on s.pair_id = r.pair_id where y is not null and coalesce(claim.passage, '') <> ''), n as (select *, row_number() over (order by b, c desc nulls last, pair_id, sample_id) k from s where y = 0 and b is not null), k as (select sample_id, pair_id, room_id, y, c from n where k <= (select round_even(sum(y) * 1.5, 0) from s) union all select sample_id, pair_id, room_id, y, c from s where y = 1) select *, row_number() over (order by room_id nulls first, pair_id, sample_id) place from k",
    "injection_prefixes": "with r as (select sample_id, row_number() over (order by md5(sample_id::varchar), sample_id) rn, count(*) over () n from samples where split = 'train') select f::int f, count(*) n_rows, sum(sample_id)::bigint id_sum from r, unnest([0, 20, 40, 60, 80, 100]) t(f) where rn <= round(f * n / 100.0) group by f",
    "positional_align": "with a as (select sample_id, pair_id, row_number() over (order by sample_id) pos from samples where split = 'test'), i as (select pair_id, max(sample_id) other_id from samples where split is null or split <> 'test' group by 1), p as (select c score, row_number() over (order by loaded_ts, sample_id) pos from samples where split = 'test'), v as (select c, row_number() over (order by sample_id) pos, count(*) over () m from samples where split = 'val') select a.pos, a.sample_id, i.other_id, p.score, case when v.m = (select count(*) from a) then v.c end val_score from a left join i on a.pair_id = i.pair_id left join p on a.pos = p.pos left join v on a.pos = v.pos",
    "holdout_rooms": f"with {_VOL} select room_id, volume::bigint volume, i from held",
    "category_folds": f"with {_R}, n as (select distinct category fold from category_schema), rows_ as (select fold, sample_id, coalesce(category = fold, false) held from samples s join r on s.pair_id = r.pair_id, n), {_PARTS} {_SUM}",
    "room_folds": f"with {_VOL}, rows_ as (select 'rooms' fold, sample_id, held.room_id is not null held from samples s left join r on s.pair_id = r.pair_id left join held on r.room_id = held.room_id), {_PARTS} {_SUM}",
    "time_split": f"with x0 as (select sample_id, unnest(reviews) x from samples), t as (select sample_id, min({_TS}) t from x0 group by 1), rows_ as (select 'time' fold, s.sample_id, t.t, coalesce(t.t >= timestamp '2025-02-15', false) held from samples s left join t using (sample_id)), {_PARTS} select sample_id, part, case when t < timestamp '2025-01-01' then 'early' when held then 'late' else 'background' end stage from parts join (select sample_id, t, held from rows_) using (sample_id)",
    "stratified_half": f"with r as (select sample_id, y, row_number() over (partition by y order by {_H}) rn, count(*) over (partition by y) n from samples where y is not null) select sample_id, y from r where rn <= floor(n / 2)",
    "capped_sample": f"with v as (select sample_id, y, row_number() over (partition by y = 1 order by {_H}) k, count(*) over () m from samples where split = 'val' and y is not null) select sample_id, y from v where m <= 100 or k <= 50",
    "room_split_greedy": f"""with recursive {_G}, k as (select *, row_number() over (order by n desc, pos desc, room) i, (sum(n) over ())::double tn, (sum(pos) over ())::double tp from g),
 w as (select 0::bigint i, ''::varchar room, 0::bigint n, 0::hugeint pos, ''::varchar split, 0::double an, 0::double ap, 0::double bn, 0::double bp, 0::double cn, 0::double cp
 union all select i, room, n, pos, s, an + case when s = 'train' then n else 0 end, ap + case when s = 'train' then pos else 0 end, bn + case when s = 'val' then n else 0 end, bp + case when s = 'val' then pos else 0 end, cn + case when s = 'test' then n else 0 end, cp + case when s = 'test' then pos else 0 end
  from (select k.i, k.room, k.n, k.pos, an, ap, bn, bp, cn, cp, case when ({_ERR('a')}) <= least(({_ERR('b')}), ({_ERR('c')})) then 'train' when ({_ERR('b')}) <= ({_ERR('c')}) then 'val' else 'test' end s from w join k on k.i = w.i + 1))
 select room room_id, n, pos::bigint pos, split from w where i > 0""",
    "room_split_deficit": f"""with recursive {_G}, k as (select room, n, row_number() over (order by n desc, room) i, sum(n) over () t from g), w as (select 0::bigint i, 0::bigint n, ''::varchar split, 0::double a, 0::double b, 0::double c union all select i, n, s, a + case when s = 'train' then n else 0 end, b + case when s = 'val' then n else 0 end, c + case when s = 'test' then n else 0 end from (select k.i, k.n, a, b, c, case when 7 * t - 10 * a >= greatest(t - 10 * b, 2 * t - 10 * c) then 'train' when t - 10 * b >= 2 * t - 10 * c then 'val' else 'test' end s from w join k on k.i = w.i + 1)),
 m as (select n, split, row_number() over (partition by n order by case split when 'train' then 0 when 'val' then 1 else 2 end) k from w where i > 0), o as (select room, n, row_number() over (partition by n order by room) k from g) select o.room room_id, o.n, m.split from o join m on o.n = m.n and o.k = m.k""",
}
