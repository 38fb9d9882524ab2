"""Retrieval over the embeddings and metrics of the samples' weights as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import vectors as V
from lodeweave.operators import metrics as M
from lodeweave.operators import retrieval as R
from lodeweave.session import cut, table


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with an attribute, a label and a weight: id, embedding, attr, y, c."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.expr("label div 2").cast("int").alias("attr"), (F.col("label") % 2).alias("y"), ((F.col("vec_id") % 17 + 1) / 20).alias("c"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return rows.filter("id % 50 = 0")


def knn_global(spark, sf_dir):
    """Ten nearest of all rows."""
    b = bank(spark, sf_dir)
    return R.nearest(_asked(b), b, 10).select("query_id", "rank", "id", "sim")


def knn_attr_block(spark, sf_dir):
    """Nearest of all rows of the same attribute, of all attributes where there are fewer than three."""
    b = bank(spark, sf_dir)
    return R.nearest_with_fallback(_asked(b), b, "attr").select("query_id", "rank", "id", "sim")


def hard_negatives(spark, sf_dir):
    """Farthest rows of the query's label."""
    b = bank(spark, sf_dir)
    return R.nearest(_asked(b), b, 5, within="y", hardest=True).select("query_id", "rank", "id", "sim")


def rkc_vote(spark, sf_dir):
    """Weighted vote of the ten nearest."""
    b = bank(spark, sf_dir)
    return R.vote(R.nearest(_asked(b), b, 10), b).select("query_id", F.round("vote", 5).alias("vote"), "n")


def vote_k15(spark, sf_dir):
    """Fifteen nearest, weights of at least 0.05."""
    b = bank(spark, sf_dir)
    return R.vote(R.nearest(_asked(b), b, 15), b, floor=0.05).select("query_id", F.round("vote", 5).alias("vote"), "n")


def label_match_map10(spark, sf_dir):
    """Label match and attribute precision of ten neighbours other than the row."""
    b = bank(spark, sf_dir)
    t = R.retrieval_quality(R.nearest(_asked(b), b, 10), b)
    return t.select(F.round("label_match", 5).alias("label_match"), F.round("attr_map", 5).alias("attr_map"), "n")


def infonce_value(spark, sf_dir):
    """M4: contrastive value over ten neighbours."""
    b = bank(spark, sf_dir)
    return R.contrast_value(R.nearest(_asked(b), b, 10), b).select("query_id", F.round("loss", 4).alias("loss"))


def prototype_vectors(spark, sf_dir):
    """Weighted unit mean of each attribute."""
    return R.prototypes(bank(spark, sf_dir), "attr").select("attr", "pos", F.round("value", 5).alias("value"))


def prototype_losses(spark, sf_dir):
    """M5: prototype relation loss of each query within its attribute, else among all rows."""
    b = bank(spark, sf_dir).withColumn("stratum", F.concat_ws("-", F.col("attr"), F.col("id") % 13))
    return R.prototype_loss(_asked(b), b, "stratum", c_min=0.1).select("query_id", "level", F.round("loss", 5).alias("loss"))


def library_injection(spark, sf_dir):
    """J28, ST4: votes with a library that grows by a third each time; one scan for all of them."""
    b = bank(spark, sf_dir)
    shares = F.array(*map(F.lit, (34, 67, 100)))
    library = b.withColumn("share", F.explode(F.filter(shares, lambda s: F.col("id") % 100 < s)))
    asked = _asked(b).select("id", "embedding", F.explode(shares).alias("share"))
    coded = lambda rows: rows.withColumn("id", F.col("id") * 4 + F.col("share") % 4)  # noqa: E731  a number for each row and share
    found = R.nearest(coded(asked), coded(library), 10, within="share")
    plain = found.select((F.col("query_id") % 4).alias("s"), F.col("query_id"), F.floor(F.col("id") / 4).alias("id"), "sim")
    votes = R.vote(plain, b).withColumn("share", F.element_at(F.create_map(*[F.lit(x) for s in (34, 67, 100) for x in (s % 4, s)]), (F.col("query_id") % 4).cast("int")))
    return votes.groupBy("share").agg(F.round(F.avg("vote"), 5).alias("mean_vote"), F.count("*").alias("n"))


def geometry(spark, sf_dir):
    """Alignment, uniformity, silhouette, purity, accuracy, F1, margins and the hardest quarter of the queries against all other rows."""
    b = bank(spark, sf_dir)
    t = R.geometry(_asked(b), b.filter("id % 50 <> 0"))
    return t.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in t.dtypes])


def _halves(spark, sf_dir) -> DataFrame:
    """The bank with the two halves of a vector as that of the claim and of the evidence."""
    b = bank(spark, sf_dir)
    n = F.floor(F.size("embedding") / 2).cast("int")
    return b.withColumns({"claim": F.slice("embedding", 1, n), "evidence": F.slice("embedding", n + 1, n)})


def _confounders(spark, sf_dir) -> DataFrame:
    b = _halves(spark, sf_dir)
    return R.pairs_where(_asked(b).filter("y = 1"), b.filter("y = 0"), ["evidence", "claim", "embedding"], lambda s: s[0] >= 0.2, within="attr")


def confounder_pairs(spark, sf_dir):
    """All pairs of a positive query and a negative row of its attribute whose evidence is alike."""
    return _confounders(spark, sf_dir).select("query_id", "id", F.col("evidence").alias("evidence_sim"), F.col("claim").alias("claim_sim"))


def cross_attribute_pairs(spark, sf_dir):
    """All pairs of a positive query and a negative row of any attribute whose claims are alike and whose evidence is not."""
    b = _halves(spark, sf_dir)
    pairs = R.pairs_where(_asked(b).filter("y = 1"), b.filter("y = 0"), ["claim", "evidence"], lambda s: (s[0] >= 0.3) & (s[1] < 0.2))
    return pairs.select("query_id", "id", F.col("claim").alias("claim_sim"), F.col("evidence").alias("evidence_sim"))


def confounder_summary(spark, sf_dir):
    """Number of confounder pairs, mean similarity in two spaces, its reduction and shares below zero and below the other."""
    p = _confounders(spark, sf_dir)
    t = p.agg(F.count("*").alias("n_pairs"), F.avg("claim").alias("a"), F.avg("embedding").alias("b"), F.avg((F.col("claim") < 0).cast("double")).alias("neg_a"), F.avg((F.col("embedding") < 0).cast("double")).alias("neg_b"), F.avg((F.col("embedding") < F.col("claim")).cast("double")).alias("pushed_down"))
    out = {"mean_first": F.col("a"), "mean_second": F.col("b"), "reduction": F.col("a") - F.col("b"), "relative": 100 * (F.col("a") - F.col("b")) / F.nullif(F.abs("a"), F.lit(0.0)), "negative_first": F.col("neg_a"), "negative_second": F.col("neg_b"), "pushed_down": F.col("pushed_down")}
    return t.select("n_pairs", *[F.round(v, 3).alias(k) for k, v in out.items()])


def argmax_match(spark, sf_dir):
    """The nearest row of the same attribute, where it is near enough."""
    b = bank(spark, sf_dir)
    return R.nearest(_asked(b), b, 1, within="attr").filter("sim >= 0.35").select("query_id", "id", "sim")


def _masked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Queries and the eligible rows: sure enough, with a kind of evidence."""
    b = bank(spark, sf_dir).withColumn("kind", (F.col("id") % 3).cast("string"))
    return _asked(b), b.filter("c >= 0.3 and id % 7 <> 0")


def candidate_masks(spark, sf_dir):
    """three nearest positives and negatives of each query among the eligible rows. Positives: same
    attribute and label, of any attribute if there is none. Negatives: other label, of the same attribute and kind of evidence, else attribute, else any."""
    asked, rows = _masked(spark, sf_dir)
    out = None
    for side, levels in (("positive", (["attr", "want"], ["want"])), ("negative", (["attr", "want", "kind"], ["attr", "want"], ["want"]))):
        q = asked.withColumn("want", F.col("y") if side == "positive" else 1 - F.col("y"))
        library = rows.withColumn("want", F.col("y"))
        chosen = R.first_level(q, library, 1, *levels)
        found = R.nearest(chosen, R.tagged(library, *levels), 3, within="tag").join(chosen.select(F.col("id").alias("query_id"), "level", "candidates"), "query_id").select("query_id", F.lit(side).alias("side"), "level", "candidates", "rank", "id", "sim")
        out = found if out is None else out.unionByName(found)
    return out


def bonus_neighbours(spark, sf_dir):
    """Five nearest rows of the other label, those of the same kind of evidence with a bonus of 0.1."""
    asked, rows = _masked(spark, sf_dir)
    q = asked.withColumn("want", 1 - F.col("y"))
    return R.nearest(q, rows.withColumn("want", F.col("y")), 5, within="want", bonus=0.1, mark="kind").select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


def cosine_scores(spark, sf_dir):
    """Cosine of each row's claim and evidence vectors brought to the range from 0 to 1, with the norms of their difference and product."""
    b = _halves(spark, sf_dir)
    x, y = F.col("claim"), F.col("evidence")
    features = V.pair_features(x, y)
    n = F.size(x)
    part = lambda i: F.slice(features, i * n + 1, n)
    return b.select("id", F.round((V.cosine(x, y) + 1) / 2, 6).alias("score"), F.size(features).alias("width"), F.round(V.norm(part(2)), 5).alias("difference"), F.round(V.norm(part(3)), 5).alias("product"))


def scores(spark, sf_dir) -> DataFrame:
    """p: weight to two digits; q: evidence share; y."""
    s = table(spark, sf_dir, "samples")
    n = F.coalesce(F.col("evidence_count.params"), F.lit(0)) + F.coalesce(F.col("evidence_count.ocr"), F.lit(0)) + F.coalesce(F.col("evidence_count.vlm"), F.lit(0))
    return s.filter("y is not null and c is not null").select(F.round("c", 2).alias("p"), F.least(F.lit(1.0), n / 12.0).alias("q"), "y")


_GRID = [round(0.02 * i, 2) for i in range(1, 50)]
_ALPHA = [round(0.1 * i, 1) for i in range(11)]
_ALPHA21 = [round(0.05 * i, 2) for i in range(21)]
_r = lambda df, n=6: df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ranking(spark, sf_dir):
    """Average precision and area under the ROC curve."""
    return _r(M.ranking_metrics(scores(spark, sf_dir)))


def partial_auprc(spark, sf_dir):
    """Area of the precision-recall curve at recall 0.7 and more."""
    return _r(M.partial_pr_area(scores(spark, sf_dir)))


def confusion(spark, sf_dir):
    """Metrics of the scores at one half."""
    return _r(M.confusion_metrics(scores(spark, sf_dir)))


def ece(spark, sf_dir):
    """Expected calibration error of fifteen bins."""
    return _r(M.calibration_error(scores(spark, sf_dir)))


def reliability_bins(spark, sf_dir):
    """Ten reliability bins."""
    return _r(M.calibration_bins(scores(spark, sf_dir), 10))


def threshold_sweep(spark, sf_dir):
    """Macro F1 and MCC at 49 thresholds."""
    return _r(M.threshold_sweep(scores(spark, sf_dir), _GRID))


def best_threshold(spark, sf_dir):
    """First threshold of the highest macro F1."""
    return _r(M.best_threshold(scores(spark, sf_dir), _GRID))


def alpha_sweep(spark, sf_dir):
    """Average precision of eleven mixtures of two scores."""
    return _r(M.alpha_sweep(scores(spark, sf_dir), _ALPHA), 5)


def alpha_macro_f1(spark, sf_dir):
    """Best macro F1 over the thresholds for each of 21 mixtures of two scores."""
    return _r(M.alpha_thresholds(scores(spark, sf_dir), _ALPHA21, _GRID))


def temperature(spark, sf_dir):
    """Temperature in the bounds that gives the least mean log loss of the scores' logits, the first of a fine grid."""
    return _r(M.temperature(scores(spark, sf_dir), [round(0.05 * i, 2) for i in range(1, 201)]))


def evaluation_row(spark, sf_dir):
    """One row of all metrics of the test part, thresholds and mixing weight chosen on the validation part."""
    s = table(spark, sf_dir, "samples")
    n = F.coalesce(F.col("evidence_count.params"), F.lit(0)) + F.coalesce(F.col("evidence_count.ocr"), F.lit(0)) + F.coalesce(F.col("evidence_count.vlm"), F.lit(0))
    rows = s.filter("y is not null and c is not null and split in ('val', 'test')").select("split", F.round("c", 2).alias("p"), F.least(F.lit(1.0), n / 12.0).alias("q"), "y", F.greatest("c", F.lit(0.05)).alias("w"))
    return _r(M.evaluation_row(cut(rows.filter("split = 'val'")), cut(rows.filter("split = 'test'")), _ALPHA, _GRID), 5)


def selective_coverage(spark, sf_dir):
    """Accuracy of the rows on which two scores agree best."""
    return _r(M.selective(scores(spark, sf_dir), [0.65, 0.7, 0.8, 1.0]))


QUERIES = {f.__name__: f for f in (knn_global, knn_attr_block, hard_negatives, rkc_vote, vote_k15, label_match_map10, infonce_value, prototype_vectors, prototype_losses, library_injection, geometry, confounder_pairs, cross_attribute_pairs, confounder_summary, argmax_match, candidate_masks, bonus_neighbours, cosine_scores, ranking, partial_auprc, confusion, ece, reliability_bins, threshold_sweep, best_threshold, alpha_sweep, alpha_macro_f1, temperature, evaluation_row, selective_coverage)}

_B = "b as (select vec_id id, list_transform(embedding, lambda v: v::double) v, label // 2 attr, label % 2 y, (vec_id % 17 + 1) / 20 c from embeddings), n as (select *, sqrt(list_dot_product(v, v)) len from b), q as (select id qid, v qv, attr qa, y qy, len ql from n where id % 50 = 0)"
_SIM = "round(list_dot_product(qv, v) / (ql * len), 6)"
_TOP = "k as (select qid query_id, id, attr, y, c, qa, qy, {sim} sim, row_number() over (partition by qid order by {sim} {way}, id) rank from q join n on qid <> id and ({on})), t as (select * from k where rank <= {k})"
_knn = lambda k, on="true", way="desc": f"with {_B}, {_TOP.format(sim=_SIM, way=way, on=on, k=k)} "
_VOTE = "select query_id, round(sum(greatest(c, {floor}) * greatest(sim, 0) * y) / (sum(greatest(c, {floor}) * greatest(sim, 0)) + 1e-8), 5) vote, count(*) n from t group by 1"
_S = "s as (select round(c, 2) p, least(1.0, (coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0)) / 12.0) q, y from samples where y is not null and c is not null)"
_AT = "g as (select p, sum(y) pos, count(*) n from s group by p), r as (select *, sum(pos) over (order by p desc) tp, sum(n) over (order by p desc) np from g)"
_CM = "sum(case when p >= {t} and y = 1 then 1.0 else 0 end) tp, sum(case when p >= {t} and y = 0 then 1.0 else 0 end) fp, sum(case when p < {t} and y = 1 then 1.0 else 0 end) fn, sum(case when p < {t} and y = 0 then 1.0 else 0 end) tn"
_F1 = "case when 2*tp+fp+fn = 0 then 0 else 2*tp/(2*tp+fp+fn) end"
_F0 = "case when 2*tn+fp+fn = 0 then 0 else 2*tn/(2*tn+fp+fn) end"
_MCC = "case when (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 then 0 else (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) end"
_best = lambda rows, name: f"{name}_c as (select t, {_CM.format(t='t')} from {rows}, (select unnest({_GRID}) t) group by t), {name} as (select arg_max(t, (round(({_F1} + {_F0}) / 2, 9), -t))::double t from {name}_c)"
_told = lambda rows, at, name: f"""{name}_x as (select p >= t h, y, w from {rows}, {at}), {name}_k as (select sum((h and y = 1)::int)::double tp, sum((h and y = 0)::int)::double fp, sum((not h and y = 1)::int)::double fn, sum((not h and y = 0)::int)::double tn, sum(case when h and y = 1 then w else 0 end) wtp, sum(case when h and y = 0 then w else 0 end) wfp, sum(case when not h and y = 1 then w else 0 end) wfn, sum(case when not h and y = 0 then w else 0 end) wtn from {name}_x),
 {name}_g as (select p, sum(y) pos, count(*) n from {rows} group by p), {name}_r as (select *, sum(pos) over (order by p desc) tp, sum(n) over (order by p desc) np from {name}_g), {name}_s as (select sum(pos * tp / np) / sum(pos) ap, sum((n - pos) * (tp - pos + pos / 2)) / (sum(pos) * sum(n - pos)) auroc from {name}_r),
 {name} as (select (tp + tn) / (tp + fp + fn + tn) acc, ({_F1} + {_F0}) / 2 macro_f1, {_F1} pos_f1, (2 * wtp / (2 * wtp + wfp + wfn) + 2 * wtn / (2 * wtn + wfp + wfn)) / 2 wf, ap, auroc from {name}_k, {name}_s)"""  # noqa: E731
_HALF = f"{_B}, h as (select *, sqrt(list_dot_product(v[1:32], v[1:32])) cl, sqrt(list_dot_product(v[33:64], v[33:64])) el from n), pr as (select a.id query_id, b.id, a.attr qa, b.attr, round(list_dot_product(a.v[33:64], b.v[33:64]) / (a.el * b.el), 6) es, round(list_dot_product(a.v[1:32], b.v[1:32]) / (a.cl * b.cl), 6) cs, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) gs from h a join h b on a.id <> b.id where a.id % 50 = 0 and a.y = 1 and b.y = 0)"
_SWEEP = f"with {_S}, gr as (select unnest({_GRID}) t), c as (select t, {_CM.format(t='t')} from s, gr group by t), o as (select t::double t, ({_F1} + {_F0}) / 2 macro_f1, case when tp+fp = 0 or fn+tn = 0 then -1.0 else {_MCC} end mcc from c)"
SQL = {
    "knn_global": _knn(10) + "select query_id, rank, id, sim from t",
    "knn_attr_block": _knn(10, "qa = attr") + "select query_id, rank, id, sim from t",
    "hard_negatives": _knn(5, "qy = y", "asc") + "select query_id, rank, id, sim from t",
    "rkc_vote": _knn(10) + _VOTE.format(floor=0),
    "vote_k15": _knn(15) + _VOTE.format(floor=0.05),
    "label_match_map10": _knn(10) + ", p as (select *, (attr = qa)::int rel from t), w as (select *, sum(rel) over (partition by query_id order by rank) / rank prec from p), m as (select query_id, avg((y = qy)::int) m, coalesce(sum(prec * rel) / nullif(sum(rel), 0), 0) ap from w group by 1) select round(avg(m), 5) label_match, round(avg(ap), 5) attr_map, count(*) n from m",
    "infonce_value": _knn(10) + ", m as (select query_id, sum(exp(sim / 0.1)) filter (y = qy) a, sum(exp(sim / 0.1)) b from t group by 1) select query_id, round(-ln(a / b), 4) loss from m where a is not null",
    "prototype_vectors": f"with {_B}, l as (select attr, c, unnest(v) x, generate_subscripts(v, 1) - 1 pos from b), m as (select attr, pos, sum(c * x) / sum(c) m from l group by 1, 2) select attr, pos::int pos, round(m / sqrt(sum(m * m) over (partition by attr)), 5) as \"value\" from m",
    "prototype_losses": f"""with {_B}, r as (select *, attr || '-' || id % 13 st, list_transform(v, lambda x: x / len) u from n where c >= 0.1), tg as (select '0/' || st tag, y, c, u from r union all select '1/', y, c, u from r), ct as (select tag, sum(y) p, sum(1 - y) g from tg group by 1),
 lo as (select tag, y, generate_subscripts(u, 1) k, c, unnest(u) x from tg), me as (select tag, y, k, sum(c * x) m from lo group by 1, 2, 3), le as (select tag, y, sqrt(sum(m * m)) z from me group by 1, 2), pr as (select me.tag, me.y, list(m / z order by k) w from me join le on me.tag = le.tag and me.y = le.y group by 1, 2),
 q1 as (select id, y, c, u, '0/' || st tag, 0 lv from r where id % 50 = 0 union all select id, y, c, u, '1/', 1 from r where id % 50 = 0),
 sc as (select q1.*, list_dot_product(u, a.w) / 0.1 sp, list_dot_product(u, b.w) / 0.1 sn from q1 join pr a on a.tag = q1.tag and a.y = 1 join pr b on b.tag = q1.tag and b.y = 0 join ct on ct.tag = q1.tag where lv = 1 or (p >= 3 and g >= 3)),
 o as (select *, row_number() over (partition by id order by lv) k from sc) select id query_id, lv \"level\", round(c * (ln(exp(sp) + exp(sn)) - case when y = 1 then sp else sn end), 5) loss from o where k = 1""",
    "library_injection": " union all ".join(f"select * from ({_knn(10, f'id % 100 < {s}')}, o as (select query_id, sum(c * greatest(sim, 0) * y) / (sum(c * greatest(sim, 0)) + 1e-8) vote from t group by 1) select {s} as share, round(avg(vote), 5) mean_vote, count(*) n from o)" for s in (34, 67, 100)),
    "geometry": f"""with {_B}, te as (select qid id, qv v, qy y, ql len from q), tr as (select id, v, y, len from n where id % 50 <> 0),
 pr as (select a.id i, b.id j, a.y yi, b.y yj, list_dot_product(a.v, b.v) / (a.len * b.len) s from te a join te b on a.id <> b.id), pd as (select avg(2 - 2 * s) filter (yi = yj) alignment, avg(2 - 2 * s) filter (yi = 1 and yj = 1) alignment_pos, ln(avg(exp(-2 * (2 - 2 * s)))) uniformity from pr),
 sl as (select i, avg(1 - s) filter (yi = yj) a, avg(1 - s) filter (yi <> yj) b from pr group by 1), si as (select avg(coalesce((b - a) / greatest(a, b), 0)) silhouette from sl),
 x as (select te.id i, te.y yi, tr.id j, tr.y yj, round(list_dot_product(te.v, tr.v) / (te.len * tr.len), 6) s from te, tr), k as (select *, row_number() over (partition by i order by s desc, j) r from x),
 m as (select i, yi, avg((yi = yj)::int) filter (r <= 1) p1, avg((yi = yj)::int) filter (r <= 5) p5, avg((yi = yj)::int) filter (r <= 10) p10, avg((yi = yj)::int) filter (r <= 20) p20, (avg(yj) filter (r <= 10) > 0.5)::int vote, max(s) filter (yi = yj) same, max(s) filter (yi <> yj) other from k group by 1, 2),
 h as (select quantile_cont(other, 0.75) q from m)
 select round(avg(p1), 4) purity_1, round(avg(p5), 4) purity_5, round(avg(p10), 4) purity_10, round(avg(p20), 4) purity_20, round(avg((vote = yi)::int), 4) knn_acc, round(2.0 * sum((vote = 1 and yi = 1)::int) / (2 * sum((vote = 1 and yi = 1)::int) + sum((vote <> yi)::int)), 4) knn_f1, round(avg(same - other), 4) margin, round(avg((same > other)::int), 4) margin_pos, round(avg(same - other) filter (other >= q - 1e-12), 4) hard_margin, round(avg(p10) filter (other >= q - 1e-12), 4) hard_purity, count(*) n, round(any_value(alignment), 4) alignment, round(any_value(alignment_pos), 4) alignment_pos, round(any_value(silhouette), 4) silhouette, round(any_value(uniformity), 4) uniformity from m, h, pd, si""",
    "confounder_pairs": f"with {_HALF} select query_id, id, es evidence_sim, cs claim_sim from pr where attr = qa and es >= 0.2",
    "cross_attribute_pairs": f"with {_HALF} select query_id, id, cs claim_sim, es evidence_sim from pr where cs >= 0.3 and es < 0.2",
    "confounder_summary": f"with {_HALF}, k as (select * from pr where attr = qa and es >= 0.2) select count(*) n_pairs, round(avg(cs), 3) mean_first, round(avg(gs), 3) mean_second, round(avg(cs) - avg(gs), 3) reduction, round(100 * (avg(cs) - avg(gs)) / abs(avg(cs)), 3) as \"relative\", round(avg((cs < 0)::int), 3) negative_first, round(avg((gs < 0)::int), 3) negative_second, round(avg((gs < cs)::int), 3) pushed_down from k",
    "argmax_match": _knn(1, "qa = attr") + "select query_id, id, sim from t where sim >= 0.35",
    "candidate_masks": f"""with {_B}, e as (select *, id % 3 kind from n where c >= 0.3 and id % 7 <> 0), x as (select qid, id, round(list_dot_product(qv, v) / (ql * len), 6) s, qa = attr sa, qy = y sy, qid % 3 = kind sk from q join e on qid <> id),
 l as (select *, 'positive' side, case when sa then 0 else 1 end lv from x where sy union all select *, 'negative', case when sa and sk then 0 when sa then 1 else 2 end from x where not sy),
 bl as (select qid, side, min(lv) best from l group by 1, 2), c as (select l.*, best, row_number() over (partition by qid, side order by s desc, id) rank, count(*) over (partition by qid, side) candidates from l join bl using (qid, side) where case when best = 0 then lv = 0 when side = 'negative' and best = 1 then lv <= 1 else true end)
 select qid query_id, side, best \"level\", candidates, rank, id, s sim from c where rank <= 3""",
    "bonus_neighbours": f"with {_B}, x as (select qid query_id, id, round(list_dot_product(qv, v) / (ql * len), 6) + case when qid % 3 = id % 3 then 0.1 else 0 end s from q join n on qid <> id and qy <> y where c >= 0.3 and id % 7 <> 0), k as (select *, row_number() over (partition by query_id order by s desc, id) rank from x) select query_id, rank, id, round(s, 6) sim from k where rank <= 5",
    "cosine_scores": f"with {_B} select id, round((list_cosine_similarity(v[1:32], v[33:64]) + 1) / 2, 6) score, 128 width, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (v[i] - v[i + 32]) ** 2))), 5) difference, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (v[i] * v[i + 32]) ** 2))), 5) product from b",
    "alpha_macro_f1": f"with {_S}, gr as (select unnest({_GRID}) t), m as (select a::double a, round(a * p + (1 - a) * q, 6) p, y from s, (select unnest({_ALPHA21}) a)), c as (select a, t, {_CM.format(t='t')} from m, gr group by a, t), o as (select a, t::double t, round(({_F1} + {_F0}) / 2, 9) f from c) select a, arg_max(t, (f, -t)) t, round(max(f), 6) best from o group by a",
    "temperature": f"with {_S}, g as (select p, sum(y) pos, count(*) n from s group by 1), z as (select *, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) z from g), k as (select unnest({[round(0.05 * i, 2) for i in range(1, 201)]})::double t), l as (select t, sum(-pos * ln(greatest(least(1 / (1 + exp(-greatest(least(z / t, 30), -30))), 1 - 1e-6), 1e-6)) - (n - pos) * ln(1 - greatest(least(1 / (1 + exp(-greatest(least(z / t, 30), -30))), 1 - 1e-6), 1e-6))) / sum(n) loss from z, k group by t) select arg_min(t, (round(loss, 9), t)) t, round(min(loss), 6) loss from l",
    "ranking": f"with {_S}, {_AT} select round(sum(pos * tp / np) / sum(pos), 6) ap, round(sum((n - pos) * (tp - pos + pos / 2)) / (sum(pos) * sum(n - pos)), 6) auroc from r",
    "partial_auprc": f"with {_S}, {_AT}, pt as (select tp / (select sum(pos) from g) rec, tp / np prec, p from r), st as (select * from pt where rec >= 0.7), d as (select rec - lag(rec) over (order by p desc) dr, (prec + lag(prec) over (order by p desc)) / 2 h from st) select round(sum(dr * h) / 0.3, 6) area from d",
    "confusion": f"with {_S}, c as (select {_CM.format(t=0.5)}, avg((p - y) ** 2) brier from s) select round((tp+tn)/(tp+fp+fn+tn), 6) acc, round(coalesce(tp/nullif(tp+fp, 0), 0), 6) as precision, round(coalesce(tp/nullif(tp+fn, 0), 0), 6) recall, round({_F1}, 6) f1, round(({_F1} + {_F0}) / 2, 6) macro_f1, round(5*tp/(5*tp+4*fn+fp), 6) f2, round(brier, 6) brier, round({_MCC}, 6) mcc, round((tp/(tp+fn) + tn/(tn+fp)) / 2, 6) balanced_acc, round(sqrt(tp/(tp+fn) * tn/(tn+fp)), 6) g_mean from c".replace("/(", "::double/(").replace("as precision", 'as "precision"'),
    "ece": f"with {_S}, b as (select len(list_filter({[i / 15 for i in range(1, 15)]}, lambda e: p >= e)) b, count(*) n, avg(p) a, avg(y) z from s group by 1) select round(sum(n * abs(a - z)) / sum(n), 6) ece from b",
    "reliability_bins": f"with {_S} select len(list_filter({[i / 10 for i in range(1, 10)]}, lambda e: p >= e))::int bin, count(*) n, round(avg(p), 6) conf, round(avg(y), 6) acc from s group by 1",
    "threshold_sweep": _SWEEP + " select t, round(macro_f1, 6) macro_f1, round(mcc, 6) mcc from o",
    "best_threshold": _SWEEP + " select t, round(macro_f1, 6) best from o order by round(macro_f1, 9) desc, t limit 1",
    "alpha_sweep": f"with {_S}, m as (select a::double a, round(a * p + (1 - a) * q, 6) p, y from s, (select unnest({_ALPHA}) a)), g as (select a, p, sum(y) pos, count(*) n from m group by 1, 2), r as (select *, sum(pos) over (partition by a order by p desc) tp, sum(n) over (partition by a order by p desc) np from g) select a, round(sum(pos * tp / np) / sum(pos), 5) ap, round(sum((n - pos) * (tp - pos + pos / 2)) / (sum(pos) * sum(n - pos)), 5) auroc from r group by a",
    "selective_coverage": f"with {_S}, d as (select *, round(abs(p - q), 6) gap from s), c as (select unnest([0, 1, 2, 3]) i, unnest([quantile_cont(gap, 0.65), quantile_cont(gap, 0.7), quantile_cont(gap, 0.8), quantile_cont(gap, 1.0)]) cut from d) select i, count(*) n, round(avg((((p + q) / 2 >= 0.5) = (y = 1))::int), 6) acc from d, c where gap <= cut group by i",
    "evaluation_row": f"""with s as (select split, round(c, 2) p, least(1.0, (coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0)) / 12.0) q, y, greatest(c, 0.05) w from samples where y is not null and c is not null and split in ('val', 'test')),
 va as (select * from s where split = 'val'), te as (select * from s where split = 'test'), {_best('va', 'th')},
 ma as (select a::double a, round(a * p + (1 - a) * q, 6) p, y from va, (select unnest({_ALPHA}) a)), mg as (select a, p, sum(y) pos, count(*) n from ma group by 1, 2), mr as (select *, sum(pos) over (partition by a order by p desc) tp, sum(n) over (partition by a order by p desc) np from mg), mp as (select a, sum(pos * tp / np) / sum(pos) ap from mr group by a), al as (select arg_max(a, (round(ap, 9), -a)) alpha from mp),
 vm as (select round(alpha * p + (1 - alpha) * q, 6) p, y, w from va, al), tm as (select round(alpha * p + (1 - alpha) * q, 6) p, y, w from te, al), {_best('vm', 'tx')}, {_told('te', 'th', 'a')}, {_told('tm', 'tx', 'b')},
 eb as (select len(list_filter({[i / 15 for i in range(1, 15)]}, lambda e: p >= e)) b, count(*) n, avg(p) x, avg(y) z from te group by 1)
 select round(a.acc, 5) acc, round(a.macro_f1, 5) macro_f1, round(a.pos_f1, 5) pos_f1, round(a.wf, 5) weighted_f1, round(a.ap, 5) ap, round(a.auroc, 5) auroc, round(b.acc, 5) acc_mix, round(b.macro_f1, 5) macro_f1_mix, round(b.pos_f1, 5) pos_f1_mix, round(b.wf, 5) weighted_f1_mix, round(b.ap, 5) ap_mix, round(b.auroc, 5) auroc_mix, (select round(sum(n * abs(x - z)) / sum(n), 5) from eb) ece, (select count(*) from te) n_test, (select sum(y) from te)::bigint pos_test, (select t from th) thr, (select alpha from al) alpha from a, b""",
}
