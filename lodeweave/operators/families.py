"""Families of claims: texts of one product that contain each other, and phrase clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as X
from lodeweave.operators.components import components
from lodeweave.session import cut


#: Different texts of a block that are compared with each other directly.
FEW = 30


def _classes(claims: DataFrame, within: list[str], least: int) -> DataFrame:
    """id, within, t and the class (least id) of rows of one block with the same compact text of ``least`` characters or more."""
    t = claims.select("id", *within, X.compact(F.col("text")).alias("t")).filter(F.length("t") >= least)
    return t.join(t.groupBy(*within, "t").agg(F.min("id").alias("class")), [*within, "t"])


def containment_pairs(claims: DataFrame, within: list[str], least: int = 5) -> DataFrame:
    """a, b (a < b) of classes of equal compact texts of one block (named by their least id), one text containing the other.

    Both texts have ``least`` characters or more. In blocks of more than FEW texts the first ``least``
    characters of the shorter text must be a run of the longer one: texts are joined on block and run, not with
    all of their block. Rows with a NULL text or block are left out; repeated rows are one class.
    """
    return _contained(_classes(claims, within, least), within, least)


def _contained(classes: DataFrame, within: list[str], least: int) -> DataFrame:
    own = classes.filter("id = class").select(F.col("class").alias("c"), *within, "t")
    t = own.join(own.groupBy(*within).agg(F.count("*").alias("texts")).filter("texts > 1"), within)
    few, many = t.filter(F.col("texts") <= FEW), t.filter(F.col("texts") > FEW)
    side = lambda rows, c, name: rows.select(F.col("c").alias(c), *within, F.col("t").alias(name))
    direct = side(few, "x", "tx").join(side(few, "y", "ty"), within).filter("x <> y and contains(ty, tx)").select("x", "y")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - least + 1), lambda i: F.substring(F.col("t"), i, F.lit(least))))
    long = many.select(F.col("c").alias("y"), *within, F.explode(runs).alias("run"))
    short = many.select(F.col("c").alias("x"), *within, F.substring("t", 1, least).alias("run"))
    met = short.join(long, [*within, "run"]).filter("x <> y").select("x", "y")
    by_run = met.join(many.select(F.col("c").alias("x"), F.col("t").alias("tx")), "x").join(many.select(F.col("c").alias("y"), F.col("t").alias("ty")), "y").filter("contains(ty, tx)").select("x", "y")
    return direct.unionByName(by_run).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def claim_families(claims: DataFrame, within: list[str], least: int = 5) -> DataFrame:
    """id, family (least id), size of the connected families with more than one row; equal texts of a block are one family."""
    known = cut(_classes(claims, within, least))
    name = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    pairs = _contained(known, within, least).select(name("a").alias("a"), name("b").alias("b"))
    tied = components(pairs).select(F.col("node").cast("long").alias("class"), F.col("component").cast("long").alias("component"))
    rows = known.select("id", "class").join(tied, "class", "left").select("id", F.coalesce("component", "class").alias("family"))
    return rows.join(rows.groupBy("family").agg(F.count("*").alias("size")).filter("size > 1"), "family").select("id", "family", "size")


# Names of attributes that say nothing particular.
GENERIC = ("描述", "描述相符", "商品描述", "广告宣传", "宣传", "产品", "商品", "商品属性", "属性", "属性名", "客观属性名词短语")


def kept_claims(families: DataFrame, facts: DataFrame) -> DataFrame:
    """id, family, conflict, kept, demoted of the members of families.

    ``facts``: id, attribute, n_sources, n_aligned, y, pair_id. The kept row of a family is that of the
    highest score: no generic attribute, most sources, most aligned reviews, label 1, longest attribute,
    last pair id, last id. Where labels conflict all rows are demoted, else all but the kept one. NULLs count as 0 or empty.
    """
    name = F.regexp_replace(X.clean(F.col("attribute")), "^[<>]+|[<>]+$", "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = families.join(facts, "id").withColumn("score", F.struct((~name.isin(*GENERIC)).cast("int"), zero("n_sources"), zero("n_aligned"), (zero("y") == 1).cast("int"), F.length(name), X.clean(F.col("pair_id")), F.col("id")))
    best = rows.groupBy("family").agg(F.max_by("id", "score").alias("kept"), (F.min(zero("y")) < F.max(zero("y"))).alias("conflict"))
    return rows.join(best, "family").select("id", "family", "conflict", "kept", (F.col("conflict") | (F.col("id") != F.col("kept"))).alias("demoted"))


def alias_matches(keys: DataFrame, schema: DataFrame, most: int = 20_000) -> DataFrame:
    """attribute_id, param_key: the matching forms are equal or one contains the other.

    ``schema`` (attribute_id, name) is broadcast while it has at most ``most`` names; a larger one is
    joined on the first character of the form that is contained. ``keys`` has the distinct keys.
    """
    names = schema.select("attribute_id", X.normalized(F.col("name")).alias("p")).filter("p <> ''").distinct()
    k = keys.select("param_key", X.normalized(F.col("param_key")).alias("k")).filter("k <> ''")
    fits = F.expr("k = p or contains(k, p) or contains(p, k)")
    if names.limit(most + 1).count() <= most:
        return k.join(F.broadcast(names), fits).select("attribute_id", "param_key").distinct()
    every = lambda c: F.explode(X.characters(F.col(c)))
    inner = k.withColumn("c", every("k")).join(names.withColumn("c", F.substring("p", 1, 1)), "c").filter("contains(k, p)")
    outer = k.withColumn("c", F.substring("k", 1, 1)).join(names.withColumn("c", every("p")), "c").filter("contains(p, k)")
    return inner.unionByName(outer).select("attribute_id", "param_key").distinct()


def greedy_representatives(phrases: DataFrame, by: str, over: float = 0.8) -> DataFrame:
    """by, phrase, representative: each phrase in sorted order joins the first representative whose
    character-set similarity exceeds ``over``, else becomes one. The distinct phrases of a group
    are walked in one task; candidates come from an index by character."""

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, list[int]] = {}
        heads: list[tuple[str, frozenset]] = []
        out = []
        for phrase in sorted(set(frame["phrase"])):
            chars = frozenset(phrase)
            hits = sorted({i for c in chars for i in index.get(c, ())})
            found = next((i for i in hits if len(chars & heads[i][1]) / len(chars | heads[i][1]) > over), None)
            if found is None:
                for c in chars:
                    index.setdefault(c, []).append(len(heads))
                heads.append((phrase, chars))
                found = len(heads) - 1
            out.append((key[0], phrase, heads[found][0]))
        return pd.DataFrame(out, columns=[by, "phrase", "representative"])

    return phrases.select(by, "phrase").filter("phrase is not null").distinct().groupBy(by).applyInPandas(walk, f"{by} string, phrase string, representative string")


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number of each row: clusters of least mean distance are merged while it is at most the threshold."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def clusters(names: DataFrame, by: str, threshold: float = 0.6) -> DataFrame:
    """by, name, cluster: average linkage on bigram distances of a group's names (a schema's, some hundreds)."""

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        items = sorted(set(frame["name"]))
        grams = [frozenset(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in items]
        dist = np.array([[1 - len(a & b) / len(a | b) for b in grams] for a in grams])
        return pd.DataFrame({by: key[0], "name": items, "cluster": average_linkage(dist, threshold)})

    return names.select(by, "name").filter("name is not null").groupBy(by).applyInPandas(part, f"{by} string, name string, cluster int")


def contained(name: str, targets: list[str]) -> tuple[str, str]:
    """A stub of the decision: merge into the first target that contains the name or that it contains.
    Every name of five characters names a target that does not exist."""
    if len(name) == 5:
        return "merge", name + "?"
    found = next((t for t in targets if t in name or name in t), "")
    return ("merge", found) if found else ("new", "")


def sequential_merge(names: DataFrame, by: str, decide: Callable[[str, list[str]], tuple[str, str]] = contained) -> DataFrame:
    """by, name, target: decisions over the distinct names of a group one after the other, the shortest first.

    ``decide`` gets a name and the targets so far and says "merge" and a target, or "new"; a new name is a target
    for all later ones at once, a target that does not exist makes the name new. A group's names are walked in one task.
    """

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        targets: dict[str, None] = {}
        out = []
        for name in sorted(set(frame["name"]), key=lambda n: (len(n), n)):
            decision, target = decide(name, list(targets))
            if decision != "merge" or target not in targets:
                target = name
                targets[name] = None
            out.append((key[0], name, target))
        return pd.DataFrame(out, columns=[by, "name", "target"])

    return names.select(by, "name").filter("name is not null").distinct().groupBy(by).applyInPandas(walk, f"{by} string, name string, target string")


def salvaged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tolerant JSON: the text itself, a fenced block, the outermost braces, or the whole objects of a cut-off array."""
    import json
    import re

    def one(text):
        if text is None:
            return None
        tries = [m.group(1) for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.S)] + [text]
        tries += [text[text.find(a) : text.rfind(z) + 1] for a, z in ("{}", "[]") if a in text and text.rfind(z) > text.find(a)]
        for t in tries:
            try:
                return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)
            except ValueError:
                pass
        decoder, objects, at = json.JSONDecoder(), [], text.find("[") + 1
        while "[" in text and (at := text.find("{", at)) >= 0:
            try:
                value, at = decoder.raw_decode(text, at)
                objects.append(value)
            except ValueError:
                break
        return json.dumps(objects, ensure_ascii=False, sort_keys=True) if objects else None

    for s in batches:
        yield s.map(one)
