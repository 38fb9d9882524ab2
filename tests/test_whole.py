"""Queries that once left rows out, against plain computations over whole tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from lodeweave.session import table


def neighbours(spark, data, k, blocked=False):
    """The k nearest of all rows but the query itself: query to (id, sim)."""
    rows = table(spark, data, "embeddings").select("vec_id", "embedding", "label").collect()
    ids, attr = np.array([r[0] for r in rows]), np.array([r[2] // 2 for r in rows])
    m = np.array([r[1] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        sims = np.round(m @ m[i], 6)
        at = [j for j in np.lexsort((ids, -sims)) if j != i and (not blocked or attr[j] == attr[i])][:k]
        out[int(ids[i])] = [(int(ids[j]), float(sims[j])) for j in at]
    return out, {r[0]: r[2] % 2 for r in rows}


def test_attr_block_searches_all_rows(spark, data):
    got = {}
    for r in sorted(entry.queries()["knn_attr_block"](spark, data).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    want, _ = neighbours(spark, data, 10, blocked=True)
    assert got == {q: [i for i, _ in xs] for q, xs in want.items()}
    assert any(i % 10 >= 8 for xs in got.values() for i in xs)


@pytest.mark.parametrize("name, k, floor", [("rkc_vote", 10, 0), ("vote_k15", 15, 0.05)])
def test_votes_search_all_rows(spark, data, name, k, floor):
    got = {r.query_id: r.vote for r in entry.queries()[name](spark, data).collect()}
    near, y = neighbours(spark, data, k)
    assert got.keys() == near.keys()
    for q, xs in near.items():
        w = {i: max((i % 17 + 1) / 20, floor) * max(s, 0) for i, s in xs}
        assert got[q] == pytest.approx(sum(w[i] * y[i] for i in w) / (sum(w.values()) + 1e-8), abs=2e-5)


def test_all_reviews_are_judged(spark, data):
    got = {(r.sample_id, r.cid, r.review_id) for r in entry.queries()["positional_judgments"](spark, data).collect()}
    rows = table(spark, data, "samples").select("sample_id", "claim.passage", "reviews").collect()
    want = {(s, i, r.review_id) for s, p, rs in rows for i, r in enumerate(rs or [], 1) if len(set(p or "") & set(r.text or "")) >= 3}
    assert got == want and any(cid > 4 for _, cid, _ in got)


def test_odd_judgments_are_dropped(spark):
    from pyspark.sql import functions as F

    from lodeweave.operators.external import aligned_comments

    said = '[{"cid":2,"aligned":1},{"cid":1,"aligned":0},{"cid":0,"aligned":1},{"cid":7,"aligned":1},{"cid":"x","aligned":1},{"cid":"6","aligned":1},{"aligned":1}]'
    df = spark.createDataFrame([(said, list("abcdef")), (None, ["a"])], "r string, c array<string>")
    assert [[tuple(x) for x in r.x] for r in df.select(aligned_comments(F.col("r"), F.col("c")).alias("x")).collect()] == [[(2, "b"), (6, "f")], []]


def test_free_spans_resolve_by_whole_names(spark, data):
    names = {}
    for r in table(spark, data, "category_schema").collect():
        names.setdefault(r.category, set()).update((n, r.attribute_id) for n in [r.canonical_name, *(r.aliases or [])] if n)
    want = {}
    for r in table(spark, data, "mentions").filter("mention_type = 'free' and evidence_span is not null").collect():
        hits = sorted((-len(n), a) for n, a in names.get(r.category, ()) if n in r.evidence_span)
        want.setdefault((r.review_id, r.evidence_span), set()).add(hits[0][1] if hits else "UNRESOLVED")
    got = {(r.review_id, r.evidence_span): r.attribute_id for r in entry.queries()["free_resolution"](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[k] in v for k, v in want.items())


def test_cut_and_alias_names(spark, tmp_path):
    spark.createDataFrame([("A", "里料材质", ["内衬"], "鞋包"), ("B", "材质", [], "鞋包")], "attribute_id string, canonical_name string, aliases array<string>, category string").write.parquet(f"{tmp_path}/category_schema.parquet")
    spans = ["里料扎人", "里料材质差", "内衬破了", "材质好"]
    spark.createDataFrame([(s, "鞋包", s, "free") for s in spans], "review_id string, category string, evidence_span string, mention_type string").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {r.evidence_span: r.attribute_id for r in entry.queries()["free_resolution"](spark, str(tmp_path)).collect()}
    assert got == dict(zip(spans, ["UNRESOLVED", "A", "A", "B"]))


def test_a_cluster_must_name_a_checkpoint_folder():
    """No temporary folder of one machine stands in for a shared one, unless the master is local."""
    from types import SimpleNamespace

    import pytest

    from lodeweave import session

    def context(master, named):
        set_to = []
        c = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: {"spark.checkpoint.dir": named}, setCheckpointDir=set_to.append)
        return SimpleNamespace(sparkContext=c), set_to

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._folder(context(master, None)[0])
    fake, set_to = context("yarn", "hdfs://shared/checkpoints")
    session._folder(fake)
    assert set_to == ["hdfs://shared/checkpoints"]
    fake, set_to = context("local[4]", None)
    session._folder(fake)
    assert len(set_to) == 1


def test_stored_table_reads_back(spark):
    from lodeweave.session import stored

    df = spark.createDataFrame([(1, [1, 2], None), (2, [], "x")], "a int, b array<long>, c string")
    assert sorted(stored(df, "t").collect()) == sorted(df.collect()) and stored(df.filter("a > 5"), "t").count() == 0
