"""Weak labels and reliability weights of claims from aligned reviews.

Three variants of one formula. y is 1 if an aligned review is negative. With n aligned of N
reviews the weight starts as (1 - exp(-n / k)) * (n / (N + 1))^beta. Positive labels scale it by
the negative share of the evidence scores and by a bonus for strong negative evidence, negative
labels by a discount if the reviews look fake. Everything is computed within the row by
higher-order functions: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as X
from lodeweave.functions import times as T
from lodeweave.operators.places import quantiles
from lodeweave.session import spread


@dataclass(frozen=True)
class Engine:
    """Parameters of the label engine (fixed values) and the differences of its variants."""

    gamma: float = 2.0
    k: float = 3.0
    lam: float = 0.3
    rho: float = 0.4
    phi: float = 1.2
    beta: float = 1.0
    strong: float = 1.2
    weak: float = 0.7
    floor: float = 0.05
    low_n: int = 10
    similar: float = 0.7
    days: int = 3
    first: bool = True  # first variant: zero aligned rows get the floor, fake rules on texts


L1 = Engine()
L2 = Engine(first=False)


def parse_spec(spec: str, base: Engine = L2) -> Engine:
    """Engine with the parameters that a text such as ``k=1.5,lambda=0.1`` names."""
    names = {"lambda": "lam"}
    pairs = [p.split("=") for p in spec.replace(" ", ",").split(",") if p]
    return replace(base, **{names.get(k, k): float(v) for k, v in pairs})


def _score(r: Column, e: Engine) -> Column:
    return (F.when(F.coalesce(r["explicit_fact_hit"], F.lit(False)), 1.0 + e.gamma).otherwise(1.0)) * F.when(r["mention_strength"] == "strong", e.strong).otherwise(e.weak)


def _sum(reviews: Column, f) -> Column:
    return F.aggregate(reviews, F.lit(0.0), lambda s, r: s + f(r))


def label_weights(rows: DataFrame, aligned: str, total: str, engine: Engine = L1, span: str = "text") -> DataFrame:
    """The rows with y_new, c_new and the quantities in between.

    ``aligned``: array of review structs (polarity, mention_strength, explicit_fact_hit,
    review_time and the text field ``span``); ``total``: number of reviews. NULL arrays count as
    empty. Without aligned reviews the first variant gives y 0 and the floor, the second NULLs.
    """
    e = engine
    rows = rows.withColumn("__a", F.coalesce(F.col(aligned), F.filter(F.col(aligned), lambda r: F.lit(False)), F.expr(f"filter({aligned}, r -> false)")))
    rows = rows.withColumn("__a", F.coalesce(F.col("__a"), F.array().cast(rows.schema["__a"].dataType)))
    rows = rows.withColumn("__neg", F.filter("__a", lambda r: r["polarity"] == "neg")).withColumn("__pos", F.filter("__a", lambda r: r["polarity"] == "pos"))
    rows = rows.withColumns({"n_aligned": F.size("__a"), "n_total": F.col(total), "n_neg": F.size("__neg"), "n_pos": F.size("__pos"), "s_neg": _sum(F.col("__neg"), lambda r: _score(r, e)), "s_pos": _sum(F.col("__pos"), lambda r: _score(r, e))})
    n, total_, neg, pos = (F.col(c) for c in ("n_aligned", "n_total", "n_neg", "n_pos"))
    spans = F.filter(F.transform("__a", lambda r: F.coalesce(r[span], F.lit(""))), lambda t: t != "")
    rows = rows.withColumn("__sets", F.transform(spans, lambda t: X.bigrams(t, short_as_itself=e.first)))
    rows = rows.withColumn("__times", F.filter(F.transform("__a", lambda r: T.parsed(r["review_time"], T.FIRST if e.first else T.SECOND)), lambda t: t.isNotNull()))
    sets = F.col("__sets") if e.first else F.filter("__sets", lambda s: F.size(s) > 0)
    likeness = F.coalesce(X.mean_pairwise(sets), F.lit(0.0))
    burst = F.coalesce(T.whole_days(F.array_min("__times"), F.array_max("__times")) <= e.days, F.lit(False))
    if e.first:
        fake = ((total_ < e.low_n) & (pos == n)) | ((F.size("__sets") >= 3) & (1.0 - likeness < 1.0 - e.similar)) | ((F.size("__times") >= 3) & burst)
    else:
        fake = ((total_ < e.low_n) & (neg == 0) & (pos > 0)) | ((F.size("__sets") >= 3) & (likeness >= e.similar)) | ((n >= 3) & burst)
    base = (1.0 - F.exp(-n / F.greatest(F.lit(e.k), F.lit(1e-6)))) * F.pow(n / (total_ + 1.0), F.lit(e.beta))
    share = F.col("s_neg") + e.lam * F.col("s_pos")
    asym = F.when(share > 0, F.col("s_neg") / share).otherwise(1.0 if e.first else 0.0)
    bonus = F.when(F.exists("__neg", lambda r: (F.coalesce(r["mention_strength"], F.lit("")) == "strong") | F.coalesce(r["explicit_fact_hit"], F.lit(False))), e.phi).otherwise(1.0)
    rows = rows.withColumns({"suspected_fake": F.coalesce(fake & (n > 0), F.lit(False)), "c_base": base, "y_new": F.when(neg > 0, 1).otherwise(0)})
    c = F.when(F.col("y_new") == 1, F.least(F.lit(1.0), F.col("c_base") * asym * bonus)).otherwise(F.col("c_base") * (1.0 - e.rho * F.col("suspected_fake").cast("int")))
    rows = rows.withColumn("c_new", F.round(F.greatest(c, F.lit(e.floor)), 4)).drop("__a", "__neg", "__pos", "__sets", "__times")
    if not e.first:
        rows = rows.withColumns({k: F.when(n > 0, F.col(k)) for k in ("y_new", "c_new")})
    return rows


def aligned_reviews(samples: DataFrame) -> DataFrame:
    """sample_id, split and the reviews that support or refute the claim, with the number of all."""
    rows = samples.select("sample_id", "split", F.filter("reviews", lambda r: F.coalesce(r["relation"].isin("support", "refute"), F.lit(False))).alias("aligned"), F.coalesce(F.size("reviews"), F.lit(0)).alias("total"))
    return spread(rows)


C_TRANSFORMS = ("uniform", "inverse", "binary", "count", "sqrt")


def transformed_weights(rows: DataFrame, c: str = "c", n: str = "n_sources") -> DataFrame:
    """Counterfactual forms of a weight: one, reversed within its range, above the median, by count, root."""
    stats = rows.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.max(n).alias("__most"))
    stats = stats.join(F.broadcast(quantiles(rows, c, [0.5]).select(F.col("cut")[0].alias("__mid"))))
    x = F.col(c)
    out = {
        "c_uniform": F.lit(1.0), "c_inverse": F.col("__lo") + F.col("__hi") - x, "c_binary": F.when(x >= F.col("__mid"), 1.0).otherwise(0.05),
        "c_count": F.greatest(F.col(n) / F.greatest(F.col("__most"), F.lit(1)), F.lit(0.05)), "c_sqrt": F.sqrt(x),
    }
    return rows.join(F.broadcast(stats)).withColumns(out).drop("__lo", "__hi", "__mid", "__most")
