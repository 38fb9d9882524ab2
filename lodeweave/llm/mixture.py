"""Sources mixed to target weights (problem 8).

The tree is domain, language, source: the domain is the source's name without its number, the
language that which the document's label names. A source's target is divided among its languages
in proportion to their tokens; nodes weigh what their leaves weigh. The budget goes down the tree:
children get their part of it, at most what they hold times the source's repeats; what one child
cannot take goes to its siblings by weight, and only what the whole node cannot take goes to the
node's own siblings. A leaf's budget is met by whole epochs and by a prefix, in tokens, of one
more epoch in an order seeded by the epoch.

The driver holds one row per leaf: at most the targets times the known languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.llm.language import named
from lodeweave.session import cut, ship

SEED = 20240501
#: Documents of a bucket of the order; bits of a bucket's number, at least and at most.
BUCKET, BITS = 1000, (10, 20)


def pour(budget: float, children: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Budget of each child (weight, capacity): by weight, at most its capacity, the rest to the others."""
    given = dict.fromkeys(children, 0.0)
    open_ = {k for k, (w, c) in children.items() if w > 0 and c > 0}
    left = min(budget, sum(children[k][1] for k in open_))
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if given[k] + left * children[k][0] / total >= children[k][1]}
        if not full:
            for k in open_:
                given[k] += left * children[k][0] / total
            break
        for k in full:
            left -= children[k][1] - given[k]
            given[k] = children[k][1]
        open_ -= full
    return given


def budgets(leaves: list[dict], total: float) -> dict[tuple[str, str, str], float]:
    """Budget of each leaf (domain, language, source; weight, capacity)."""
    out = {}

    def down(rows: list[dict], budget: float, names: list[str]) -> None:
        if not names:
            for r in rows:
                out[r["domain"], r["language"], r["source"]] = min(budget, r["capacity"])
            return
        groups: dict[str, list[dict]] = {}
        for r in rows:
            groups.setdefault(r[names[0]], []).append(r)
        given = pour(budget, {k: (sum(r["weight"] for r in g), sum(r["capacity"] for r in g)) for k, g in sorted(groups.items())})
        for k, g in groups.items():
            down(g, given[k], names[1:])

    down(leaves, total, ["domain", "language", "source"])
    return out


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, language, n_tokens, times) and the shares reached per source.

    ``documents``: doc_id, source, lang, n_tokens. ``targets``: source, target_share, max_repeats;
    rows with a NULL in one of them are ignored, shares need not sum to one. ``total``: tokens of
    the mixture, by default those of the target sources' documents. Documents without a token or
    without a target are not used; a source without documents reaches nothing. Empty tables give
    no documents.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    wanted = {r[0]: (r[1], r[2]) for r in targets.filter("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats").collect()}
    known = F.col("source").isin(list(wanted)) if wanted else F.lit(False)
    docs = cut(documents.filter(known & (F.col("n_tokens") > 0)).select("doc_id", "source", F.coalesce(named(F.col("lang")), F.lit("und")).alias("language"), "n_tokens"))
    leaf_rows = docs.groupBy("source", "language").agg(F.sum("n_tokens"), F.count("*")).collect()
    held = {(r[0], r[1]): r[2] for r in leaf_rows}
    bits = min(BITS[1], max(BITS[0], (max([r[3] for r in leaf_rows], default=0) // BUCKET).bit_length()))
    by_source = {s: sum(n for (x, _), n in held.items() if x == s) for s in wanted}
    domain = lambda s: s.rstrip("0123456789").rstrip("_")
    leaves = [{"domain": domain(s), "language": lang, "source": s, "weight": wanted[s][0] * n / by_source[s], "capacity": float(n * wanted[s][1])} for (s, lang), n in held.items()]
    for s in wanted:  # a source without documents weighs in its domain, so that its part stays there if it can
        if not by_source[s]:
            leaves.append({"domain": domain(s), "language": "und", "source": s, "weight": wanted[s][0], "capacity": 0.0})
    size = float(sum(by_source.values())) if total is None else total
    plan = []
    for (_, lang, s), b in budgets(leaves, size).items():
        if n := held.get((s, lang), 0):
            whole = min(int(b // n), wanted[s][1])
            plan.append((s, lang, whole, float(b - whole * n) if whole < wanted[s][1] else 0.0))
    leaf = spark.createDataFrame(plan, "source string, language string, epochs int, rest double")
    order = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    rows = docs.join(F.broadcast(leaf), ["source", "language"]).withColumn("at", order).withColumn("bucket", F.shiftrightunsigned("at", 64 - bits))
    sums = rows.groupBy("source", "language", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source", "language").orderBy("bucket")) - F.col("n")).withColumnRenamed("n", "inside")
    placed = rows.join(before, ["source", "language", "bucket"])
    # only the bucket in which the prefix ends is put into order
    edge = placed.filter("before < rest and before + inside > rest")
    within = edge.withColumn("start", F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "language", "bucket").orderBy("at", "doc_id")) - F.col("n_tokens"))
    more = placed.filter("before + inside <= rest").select("doc_id").unionByName(within.filter("start + n_tokens / 2 <= rest").select("doc_id")).withColumn("extra", F.lit(1))
    used = rows.join(more, "doc_id", "left").withColumn("times", F.col("epochs") + F.coalesce("extra", F.lit(0))).filter("times > 0").select("doc_id", "source", "language", "n_tokens", "times")
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("uses"), F.max("times").alias("most_repeats"))
    goal = spark.createDataFrame([(s, float(w), int(m), int(by_source[s])) for s, (w, m) in sorted(wanted.items())], "source string, target_share double, max_repeats int, tokens_held long")
    shares = goal.join(reached, "source", "left").fillna(0, ["tokens", "uses", "most_repeats"])
    shares = shares.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy()), F.lit(0)), F.lit(0.0)))
    return used, shares
