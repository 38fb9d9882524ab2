"""Ranking, calibration and threshold metrics of scores p in [0, 1] against labels y in {0, 1}.

Sums over ranks are two-level: scores fall into BUCKETS equal buckets whose totals are accumulated
first, then only scores of one bucket are put into order, so that no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.operators.places import numbered, quantiles

BUCKETS = 4096


def ranked(scores: DataFrame, *keys: str, p: str = "p", y: str = "y") -> DataFrame:
    """One row per score (and key): positives and rows at it, and above it (tp_above, n_above)."""
    at = scores.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.count("*").alias("n")).withColumn("b", F.floor(F.col("p") * BUCKETS))
    total = at.groupBy(*keys, "b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    w = W.partitionBy(*keys).orderBy(F.desc("b")) if keys else W.partitionBy(F.lit(0)).orderBy(F.desc("b"))
    over = total.select(*keys, "b", (F.sum("bp").over(w) - F.col("bp")).alias("op"), (F.sum("bn").over(w) - F.col("bn")).alias("on"))
    inside = W.partitionBy(*keys, "b").orderBy(F.desc("p"))
    return at.join(over, [*keys, "b"]).select(*keys, "p", "pos", "n", (F.col("op") + F.sum("pos").over(inside) - F.col("pos")).alias("tp_above"), (F.col("on") + F.sum("n").over(inside) - F.col("n")).alias("n_above"))


def ranking_metrics(scores: DataFrame, *keys: str) -> DataFrame:
    """Average precision (tied scores as one step) and area under the ROC curve (ties count half); NULL with one class."""
    r = ranked(scores, *keys)
    tp, n = F.col("tp_above") + F.col("pos"), F.col("n_above") + F.col("n")
    neg = F.col("n") - F.col("pos")
    sums = r.groupBy(*keys).agg(F.sum(F.col("pos") * tp / n).alias("ap_sum"), F.sum(neg * (F.col("tp_above") + F.col("pos") / 2)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum(neg).alias("n_neg"))
    safe = lambda a, b: a / F.nullif(b, F.lit(0))
    return sums.select(*keys, safe(F.col("ap_sum"), F.col("n_pos")).alias("ap"), safe(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def partial_pr_area(scores: DataFrame, least_recall: float = 0.7) -> DataFrame:
    """Area under the precision-recall points with recall at least that, trapezoids, over the width."""
    r = ranked(scores)
    total = r.agg(F.sum("pos").alias("n_pos"))
    pts = numbered(r.crossJoin(F.broadcast(total)).select(((F.col("tp_above") + F.col("pos")) / F.col("n_pos")).alias("rec"), ((F.col("tp_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))).alias("prec"), "p").filter(F.col("rec") >= least_recall), F.desc("p"))
    before = pts.select((F.col("place") + 1).alias("place"), F.col("rec").alias("r0"), F.col("prec").alias("p0"))
    steps = pts.join(before, "place").select((F.col("rec") - F.col("r0")).alias("dr"), ((F.col("prec") + F.col("p0")) / 2).alias("h"))
    return steps.agg((F.sum(F.col("dr") * F.col("h")) / (1 - least_recall)).alias("area"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def f1(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    return _ratio((1 + beta**2) * tp, (1 + beta**2) * tp + beta**2 * fn + fp)


def confusion_metrics(scores: DataFrame, threshold: float = 0.5, weight: Column | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, macro F1, F2, Brier score, MCC, balanced accuracy and G-mean; 0 for 0/0."""
    w = F.lit(1.0) if weight is None else weight
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    t = scores.agg(s(hit & pos).alias("tp"), s(hit & ~pos).alias("fp"), s(~hit & pos).alias("fn"), s(~hit & ~pos).alias("tn"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return t.select(
        ((tp + tn) / (tp + fp + fn + tn)).alias("acc"), _ratio(tp, tp + fp).alias("precision"), tpr.alias("recall"), f1(tp, fp, fn).alias("f1"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
        f1(tp, fp, fn, 2.0).alias("f2"), "brier", _ratio(tp * tn - fp * fn, root).alias("mcc"), ((tpr + tnr) / 2).alias("balanced_acc"), F.sqrt(tpr * tnr).alias("g_mean"),
    )


def calibration_bins(scores: DataFrame, bins: int = 15) -> DataFrame:
    """Rows, mean score and mean label of equal bins by explicit edges; the last bin is closed."""
    edge = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(edge, lambda e: F.col("p") >= e))
    return scores.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))


def calibration_error(scores: DataFrame, bins: int = 15) -> DataFrame:
    t = calibration_bins(scores, bins)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def threshold_sweep(scores: DataFrame, grid: list[float], *keys: str) -> DataFrame:
    """Macro F1 and MCC at each threshold (of each key), from one pass of conditional sums."""
    pos = F.col("y") == 1
    sums = [F.struct(F.lit(t).alias("t"), F.sum(F.when((F.col("p") >= t) & pos, 1).otherwise(0)).cast("double").alias("tp"), F.sum(F.when((F.col("p") >= t) & ~pos, 1).otherwise(0)).cast("double").alias("fp")) for t in grid]
    one = scores.groupBy(*keys).agg(F.array(*sums).alias("s"), F.sum(F.when(pos, 1).otherwise(0)).cast("double").alias("P"), F.sum(F.when(~pos, 1).otherwise(0)).cast("double").alias("N"))
    r = one.select(*keys, F.explode("s").alias("s"), "P", "N").select(*keys, "s.*", "P", "N")
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), F.col("N") - F.col("fp")
    single = (tp + fp == 0) | (fn + tn == 0)
    mcc = F.when(single, -1.0).otherwise(_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    return r.select(*keys, "t", ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"), mcc.alias("mcc"))


def best_threshold(scores: DataFrame, grid: list[float], by: str = "macro_f1") -> DataFrame:
    """Threshold of the highest value, the first of equal ones."""
    return threshold_sweep(scores, grid).agg(F.max_by("t", F.struct(F.round(by, 9), -F.col("t"))).alias("t"), F.max(by).alias("best"))


def alpha_sweep(scores: DataFrame, alphas: list[float]) -> DataFrame:
    """Average precision of a * p + (1 - a) * q for each a."""
    mixed = scores.select(F.explode(F.array(*map(F.lit, alphas))).alias("a"), "p", "q", "y").select("a", F.round(F.col("a") * F.col("p") + (1 - F.col("a")) * F.col("q"), 6).alias("p"), "y")
    return ranking_metrics(mixed, "a")


def alpha_thresholds(scores: DataFrame, alphas: list[float], grid: list[float]) -> DataFrame:
    """a, t, best: for each a the threshold of the highest macro F1 of a * p + (1 - a) * q, the first of equal ones."""
    mixed = scores.select(F.explode(F.array(*map(F.lit, alphas))).alias("a"), "p", "q", "y").select("a", F.round(F.col("a") * F.col("p") + (1 - F.col("a")) * F.col("q"), 6).alias("p"), "y")
    return threshold_sweep(mixed, grid, "a").groupBy("a").agg(F.max_by("t", F.struct(F.round("macro_f1", 9), -F.col("t"))).alias("t"), F.max("macro_f1").alias("best"))


def temperature(scores: DataFrame, grid: list[float]) -> DataFrame:
    """t, loss: the temperature by which logits are divided for the least mean log loss. Equal scores are counted first."""
    clipped = lambda x: F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))
    at = scores.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("z", F.log(clipped(F.col("p")) / (1 - clipped(F.col("p")))))
    p = clipped(1 / (1 + F.exp(-F.greatest(F.least(F.col("z") / F.col("t"), F.lit(30.0)), F.lit(-30.0)))))
    tried = at.select("pos", "n", "z", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    losses = tried.groupBy("t").agg((F.sum(-F.col("pos") * F.log(p) - (F.col("n") - F.col("pos")) * F.log(1 - p)) / F.sum("n")).alias("loss"))
    return losses.agg(F.min_by("t", F.struct(F.round("loss", 9), "t")).alias("t"), F.min("loss").alias("loss"))


def evaluation_row(val: DataFrame, test: DataFrame, alphas: list[float], grid: list[float]) -> DataFrame:
    """One row of metrics of the test scores p and of their mixture with q.

    Both: p, q, y, w (weight). The threshold is the first of the highest macro F1 on the validation rows; the mixing weight
    the first of the highest average precision there, the mixture's threshold likewise.
    """
    chosen = best_threshold(val, grid).select(F.col("t").alias("thr"))
    alpha = alpha_sweep(val, alphas).agg(F.max_by("a", F.struct(F.round("ap", 9), -F.col("a"))).alias("alpha"))
    mix = lambda rows: rows.join(F.broadcast(alpha)).select("y", "w", F.round(F.col("alpha") * F.col("p") + (1 - F.col("alpha")) * F.col("q"), 6).alias("p"))
    chosen_mix = best_threshold(mix(val), grid).select(F.col("t").alias("thr"))

    def told(rows: DataFrame, threshold: DataFrame, end: str) -> DataFrame:
        placed = rows.join(F.broadcast(threshold)).select((F.col("p") >= F.col("thr")).cast("double").alias("p"), "y", "w")
        plain, weighted = confusion_metrics(placed), confusion_metrics(placed, weight=F.col("w"))
        some = plain.select(*[F.col(c).alias(f"{n}{end}") for c, n in (("acc", "acc"), ("macro_f1", "macro_f1"), ("f1", "pos_f1"))])
        return some.join(F.broadcast(weighted.select(F.col("macro_f1").alias(f"weighted_f1{end}")))).join(F.broadcast(ranking_metrics(rows).select(F.col("ap").alias(f"ap{end}"), F.col("auroc").alias(f"auroc{end}"))))

    counts = test.agg(F.count("*").alias("n_test"), F.sum("y").alias("pos_test"))
    out = told(test, chosen, "")
    for more in (told(mix(test), chosen_mix, "_mix"), calibration_error(test), counts, chosen, alpha):
        out = out.join(F.broadcast(more))
    return out


def selective(scores: DataFrame, coverages: list[float]) -> DataFrame:
    """Accuracy of the rows whose two scores disagree least, at several coverages."""
    gap = F.round(F.abs(F.col("p") - F.col("q")), 6)
    cuts = quantiles(scores.select(gap.alias("gap")), "gap", coverages)
    rows = scores.crossJoin(F.broadcast(cuts)).select(F.posexplode("cut").alias("i", "cut"), gap.alias("gap"), ((F.col("p") + F.col("q")) / 2 >= 0.5).alias("hit"), (F.col("y") == 1).alias("pos"))
    return rows.filter("gap <= cut + 1e-12").groupBy("i").agg(F.count("*").alias("n"), F.avg((F.col("hit") == F.col("pos")).cast("double")).alias("acc"))
