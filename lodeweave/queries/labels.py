"""Label engines, their statistics and scalar codes of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import evidence as E
from lodeweave.functions import text as X
from lodeweave.functions import times as T
from lodeweave.operators import labels as L
from lodeweave.session import spread, table

AUDIT = ["sample_id", "y_new", "c_new", "n_aligned", "n_total", "n_neg", "n_pos", "s_neg", "s_pos", "suspected_fake"]


def _audit(rows: DataFrame) -> DataFrame:
    return rows.select(*AUDIT[:7], F.round("s_neg", 4).alias("s_neg"), F.round("s_pos", 4).alias("s_pos"), "suspected_fake")


def label_weight_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and weights of the first engine."""
    return _audit(L.label_weights(L.aligned_reviews(table(spark, sf_dir, "samples")), "aligned", "total", L.L1))


def label_weight_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second engine, rows with aligned reviews only."""
    return _audit(L.label_weights(L.aligned_reviews(table(spark, sf_dir, "samples")), "aligned", "total", L.L2)).filter("y_new is not null")


def label_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weight of training rows under each of several parameter texts."""
    rows = L.aligned_reviews(table(spark, sf_dir, "samples").filter("split = 'train'"))
    out = None
    for spec in ("k=1.5", "k=6", "lambda=0.1", "lambda=0.6", "rho=0.2 phi=1.5"):
        one = L.label_weights(rows, "aligned", "total", L.parse_spec(spec)).filter("c_new is not null").agg(F.count("*").alias("n"), F.round(F.avg("c_new"), 6).alias("mean_c")).withColumn("spec", F.lit(spec))
        out = one if out is None else out.unionByName(one)
    return out


_BASE = """
with a as (select sample_id, split, coalesce(len(reviews), 0) total, list_filter(coalesce(reviews, []), lambda r: r.relation in ('support', 'refute')) al from samples),
u as (select sample_id, unnest(al) r, generate_subscripts(al, 1) i from a),
p as (select sample_id, i, r.polarity pol, r.mention_strength ms, coalesce(r.explicit_fact_hit, false) ex, coalesce(r.text, '') txt,
  coalesce({formats}) ts from u),
s as (select *, (1 + case when ex then {gamma} else 0 end) * case when ms = 'strong' then 1.2 else 0.7 end sc, regexp_replace(txt, '\\s+', '', 'g') t0 from p),
g as (select sample_id, i, case when length(t0) >= 2 then list_distinct(list_transform(range(1, length(t0)), lambda k: substr(t0, k, 2))) else {short} end gs from s where txt <> ''),
pw as (select x.sample_id, avg(case when len(list_distinct(list_concat(x.gs, y.gs))) = 0 then 1.0 else len(list_intersect(x.gs, y.gs)) / len(list_distinct(list_concat(x.gs, y.gs))) end) sim from g x join g y on x.sample_id = y.sample_id and x.i < y.i where {pairs} group by 1),
gn as (select sample_id, count(*) nt from g group by 1),
m as (select a.sample_id, a.split, total n_total, len(al) n_aligned from a),
f as (select m.sample_id, m.split, m.n_total, m.n_aligned, count(*) filter (pol = 'neg') n_neg, count(*) filter (pol = 'pos') n_pos,
  coalesce(sum(sc) filter (pol = 'neg'), 0) s_neg, coalesce(sum(sc) filter (pol = 'pos'), 0) s_pos, coalesce(bool_or(ms = 'strong' or ex) filter (pol = 'neg'), false) strong_neg,
  count(ts) nts, floor(epoch(max(ts) - min(ts)) / 86400) span_d from m left join s using (sample_id) group by all),
z as (select f.*, coalesce(nt, 0) nt, coalesce(sim, 0) sim, (1 - exp(-n_aligned / {k})) * (n_aligned / (n_total + 1.0)) cb from f left join pw using (sample_id) left join gn using (sample_id)),
w as (select *, case when n_aligned = 0 then false else {fake} end suspected_fake from z),
c as (select *, case when n_neg > 0 then 1 else 0 end y_new, round(greatest(case when n_neg > 0 then least(1.0, cb * (case when s_neg + {lam} * s_pos > 0 then s_neg / (s_neg + {lam} * s_pos) else {zero} end) * case when strong_neg then {phi} else 1.0 end)
  else cb * (1 - {rho} * suspected_fake::int) end, 0.05), 4) c_new from w)
"""


def _times(*formats: str) -> str:
    return ", ".join(f"try_strptime(trim(r.review_time), '{f}')" for f in formats)


_SECOND = dict(gamma=2.0, k=3.0, lam=0.3, rho=0.4, phi=1.2, zero="0.0", formats=_times("%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y-%m-%d"), short="[]", pairs="len(x.gs) > 0 and len(y.gs) > 0", fake="(n_total < 10 and n_neg = 0 and n_pos > 0) or (nt >= 3 and sim >= 0.7) or (n_aligned >= 3 and coalesce(span_d <= 3, false))")
_FIRST = _SECOND | dict(zero="1.0", formats=_times("%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%Y-%m-%d"), short="[t0]", pairs="true", fake="(n_total < 10 and n_pos = n_aligned) or (nt >= 3 and 1.0 - sim < 1.0 - 0.7) or (nts >= 3 and coalesce(span_d <= 3, false))")
_OUT = "select sample_id, y_new, c_new, n_aligned, n_total, n_neg, n_pos, round(s_neg, 4) s_neg, round(s_pos, 4) s_pos, suspected_fake from c"


def _sweep() -> str:
    specs = {"k=1.5": {"k": 1.5}, "k=6": {"k": 6.0}, "lambda=0.1": {"lam": 0.1}, "lambda=0.6": {"lam": 0.6}, "rho=0.2 phi=1.5": {"rho": 0.2, "phi": 1.5}}
    return " union all ".join(f"select * from ({_BASE.format(**(_SECOND | v))} select count(*) n, round(avg(c_new), 6) mean_c, '{s}' spec from c where split = 'train' and n_aligned > 0)" for s, v in specs.items())


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews, aligned and negative aligned of each sample, with the neg share."""
    rows = L.aligned_reviews(table(spark, sf_dir, "samples"))
    neg = F.size(F.filter("aligned", lambda r: r["polarity"] == "neg"))
    return rows.select("sample_id", F.col("total").alias("n_total"), F.size("aligned").alias("n_aligned"), neg.alias("n_aligned_neg"))


def value_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the values of several columns, NULL as a value, in one pass."""
    s = table(spark, sf_dir, "samples")
    cols = {"split": F.col("split"), "y": F.col("y").cast("string"), "confidence": F.col("confidence"), "contrastive_mask": F.col("contrastive_mask").cast("string")}
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in cols.items()])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def crosstab_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given against recomputed label, with weight statistics."""
    new = L.label_weights(L.aligned_reviews(table(spark, sf_dir, "samples")), "aligned", "total", L.L1).select("sample_id", "y_new", "c_new")
    rows = table(spark, sf_dir, "samples").select("sample_id", "y").join(new, "sample_id")
    return rows.groupBy("y", "y_new").agg(F.count("*").alias("n"), F.min("c_new").alias("min_c"), F.max("c_new").alias("max_c"), F.round(F.avg("c_new"), 6).alias("mean_c"))


def c_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual weights."""
    rows = table(spark, sf_dir, "samples").select("sample_id", "c", E.source_total(F.col("evidence_count")).alias("n_sources"))
    out = L.transformed_weights(rows)
    return out.select("sample_id", *[F.round(x, 6).alias(x) for x in ("c_uniform", "c_inverse", "c_binary", "c_count", "c_sqrt")])


def evidence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and bins of each sample's evidence."""
    s = table(spark, sf_dir, "samples")
    n = E.source_total(F.col("evidence_count"))
    return s.select(
        "sample_id", E.combination(F.col("evidence_params"), F.col("evidence_ocr"), F.col("evidence_vlm")).alias("combo"), E.confidence_bin(F.col("confidence"), F.col("c")).alias("confidence_bin"),
        E.confidence_score(F.col("confidence")).alias("confidence_score"), n.alias("n_sources"), E.count_bin(n).alias("bin4"), E.count_bin(n, fine=True).alias("bin5"), E.has_claim(F.col("claim")).alias("has_claim"),
    )


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention times in any format, whole days from the first mention of the product to it."""
    m = table(spark, sf_dir, "mentions").select("review_id", "product_id", "review_time").distinct().withColumn("ts", T.parsed(F.col("review_time")))
    first = m.groupBy("product_id").agg(F.min("ts").alias("first_ts"))
    return m.join(first, "product_id").select("review_id", "product_id", "review_time", F.col("ts").cast("string").alias("ts"), T.whole_days(F.col("first_ts"), F.col("ts")).alias("days"))


def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms and similarities of a mention's span and text."""
    m = table(spark, sf_dir, "mentions").select("review_id", "attribute_id", "evidence_span", "review_text").distinct()
    a, b = F.col("evidence_span"), F.col("review_text")
    return m.select("review_id", "attribute_id", a.alias("span"), F.round(X.jaccard(X.characters(a), X.characters(b)), 6).alias("char_sim"), F.round(X.jaccard(X.bigrams(a), X.bigrams(b)), 6).alias("bigram_sim"), X.compact(a).alias("compact_span"), F.length(b).alias("approx_tokens"))


def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 native, X9: matching form and slug of schema names and aliases."""
    c = table(spark, sf_dir, "category_schema").select("category", F.explode(F.array_union(F.array("canonical_name"), F.col("aliases"))).alias("name")).distinct()
    return c.select("category", "name", X.normalized(F.col("name")).alias("norm"), X.slug(F.lit("GEN"), F.col("name")).alias("slug"))


def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each room by md5 modulo 100."""
    j = table(spark, sf_dir, "join_split").select("room_id").filter("room_id is not null").distinct()
    b = X.hash_bucket(F.col("room_id"))
    return j.select("room_id", b.alias("bucket"), F.when(b < 70, "train").when(b < 80, "val").otherwise("test").alias("split"))


def bigram_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise bigram similarity of the review texts of each sample."""
    rows = spread(table(spark, sf_dir, "samples").select("sample_id", F.filter(F.transform("reviews", lambda r: r["text"]), lambda t: t.isNotNull()).alias("texts")))
    sets = rows.select("sample_id", F.transform("texts", lambda t: X.bigrams(t)).alias("sets"))
    return sets.select("sample_id", F.size("sets").alias("n"), F.round(X.mean_pairwise(F.col("sets")), 6).alias("likeness")).filter("n >= 2")


def path_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip paths from their data segment on, whatever stands before it."""
    c = table(spark, sf_dir, "clips").select("clip_no", F.concat(F.lit("D:\\old\\"), F.col("srt_path")).alias("p")).distinct()
    return c.select("clip_no", X.data_path(F.col("p")).alias("path"))


def free_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the free prefix brought to one."""
    m = table(spark, sf_dir, "mentions").filter("mention_type = 'free' and evidence_span is not null").select("review_id", "attribute_id", "evidence_span", "mention_strength").distinct()
    mark = F.when(F.col("mention_strength") == "strong", "FREE::").when(F.col("mention_strength") == "weak", "free：").otherwise("Free_")
    return m.select("review_id", "attribute_id", "evidence_span", "mention_strength", X.free_phrase(F.concat(mark, F.col("evidence_span"))).alias("phrase"))


QUERIES = {f.__name__: f for f in (label_weight_l1, label_weight_l2, label_weight_sweep, pair_stats, value_histograms, crosstab_labels, c_transforms, evidence_codes, parse_times, text_similarities, normalized_keys, hash_buckets, path_remap, free_prefix, bigram_diversity)}
_NT = "coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0)"
_ANY = ", ".join(f"try_strptime(trim(review_time), '{f}')" for f in ("%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y-%m-%d %H:%M", "%Y/%m/%d", "%Y-%m-%d"))
_SET = "list_distinct(list_filter(string_split(coalesce({0}, ''), ''), lambda x: x <> ''))"
_BI = "case when length(regexp_replace(coalesce({0}, ''), '\\s+', '', 'g')) >= 2 then list_distinct(list_transform(range(1, length(regexp_replace({0}, '\\s+', '', 'g'))), lambda k: substr(regexp_replace({0}, '\\s+', '', 'g'), k, 2))) else [regexp_replace(coalesce({0}, ''), '\\s+', '', 'g')] end"
_JAC = "case when len(list_distinct(list_concat({0}, {1}))) = 0 then 1.0 else len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) end"
SQL = {
    "label_weight_l1": _BASE.format(**_FIRST) + _OUT,
    "label_weight_l2": _BASE.format(**_SECOND) + _OUT + " where n_aligned > 0",
    "label_weight_sweep": _sweep(),
    "pair_stats": "select sample_id, coalesce(len(reviews), 0)::int n_total, len(list_filter(coalesce(reviews, []), lambda r: r.relation in ('support', 'refute')))::int n_aligned, len(list_filter(coalesce(reviews, []), lambda r: r.relation in ('support', 'refute') and r.polarity = 'neg'))::int n_aligned_neg from samples",
    "value_histograms": "select field, value, count(*) n from (select 'split' field, split value from samples union all select 'y', y::varchar from samples union all select 'confidence', confidence from samples union all select 'contrastive_mask', contrastive_mask::varchar from samples) group by all",
    "crosstab_labels": _BASE.format(**_FIRST) + "select s.y, c.y_new, count(*) n, min(c_new) min_c, max(c_new) max_c, round(avg(c_new), 6) mean_c from c join samples s using (sample_id) group by all",
    "c_transforms": f"with r as (select sample_id, c, {_NT} n from samples), t as (select min(c) lo, max(c) hi, quantile_cont(c, 0.5) mid, max(n) most from r) select sample_id, 1.0::double c_uniform, round(lo + hi - c, 6) c_inverse, case when c >= mid then 1.0 else 0.05 end::double c_binary, round(greatest(n / greatest(most, 1), 0.05), 6) c_count, round(sqrt(c), 6) c_sqrt from r, t",
    "evidence_codes": f"select sample_id, coalesce(nullif(case when len(evidence_params) > 0 then 'P' else '' end || case when len(evidence_ocr) > 0 then 'O' else '' end || case when len(evidence_vlm) > 0 then 'V' else '' end, ''), 'none') combo, coalesce(nullif(trim(confidence), ''), case when c < 0.2 then 'absent' when c < 0.4 then 'low' when c < 0.7 then 'medium' else 'high' end) confidence_bin, case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end confidence_score, {_NT} n_sources, case when {_NT} <= 0 then 'src0' when {_NT} = 1 then 'src1' when {_NT} <= 3 then 'src2_3' else 'src4p' end bin4, case when {_NT} <= 0 then 0 when {_NT} = 1 then 1 when {_NT} <= 3 then 2 when {_NT} <= 8 then 3 else 4 end bin5, coalesce(claim.has_claim_srt, false) and (coalesce(len(claim.segments), 0) > 0 or coalesce(claim.passage, '') <> '') has_claim from samples",
    "parse_times": f"with m as (select distinct review_id, product_id, review_time from mentions), p as (select *, coalesce({_ANY}) ts from m), f as (select product_id, min(ts) first_ts from p group by 1) select review_id, p.product_id, review_time, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, floor(epoch(ts - first_ts) / 86400)::int as days from p join f on p.product_id = f.product_id",
    "text_similarities": f"with m as (select distinct review_id, attribute_id, evidence_span, review_text from mentions), s as (select *, {_SET.format('evidence_span')} ca, {_SET.format('review_text')} cb, {_BI.format('evidence_span')} ba, {_BI.format('review_text')} bb from m) select review_id, attribute_id, evidence_span span, round({_JAC.format('ca', 'cb')}, 6) char_sim, round({_JAC.format('ba', 'bb')}, 6) bigram_sim, lower(regexp_replace(coalesce(evidence_span, ''), '\\s+', '', 'g')) compact_span, length(review_text)::int approx_tokens from s",
    "normalized_keys": "with n as (select distinct category, unnest(list_distinct(list_concat([canonical_name], aliases))) name from category_schema), k as (select *, regexp_replace(lower(name), '[\\s\\-_/()（）·．。，,、:：;；''\"“”‘’!！?？]+', '', 'g') norm from n) select category, name, norm, 'GEN_' || coalesce(nullif(substr(upper(norm), 1, 24), ''), 'ATTR') slug from k",
    "hash_buckets": "with j as (select distinct room_id from join_split where room_id is not null), d as (select room_id, list_reduce(list_prepend(0, list_transform(string_split(md5(room_id), ''), lambda d: instr('0123456789abcdef', d) - 1)), lambda s, d: (s * 16 + d) % 100)::int bucket from j) select room_id, bucket, case when bucket < 70 then 'train' when bucket < 80 then 'val' else 'test' end split from d",
    "bigram_diversity": f"with u as (select sample_id, unnest(reviews) r, generate_subscripts(reviews, 1) i from samples), g as (select sample_id, i, {_BI.format('r.text')} b from u where r.text is not null) select x.sample_id, (select count(*) from g z where z.sample_id = x.sample_id)::int n, round(avg({_JAC.format('x.b', 'y.b')}), 6) likeness from g x join g y on x.sample_id = y.sample_id and x.i < y.i group by x.sample_id",
    "path_remap": "select distinct clip_no, srt_path path from clips",
    "free_prefix": "with m as (select distinct review_id, attribute_id, evidence_span, mention_strength, trim(regexp_replace(evidence_span, '^[\\s:：_]+', ''), ' ') t from mentions where mention_type = 'free' and evidence_span is not null) select review_id, attribute_id, evidence_span, mention_strength, case when t <> '' then 'FREE::' || t end phrase from m",
}
