"""Core operators against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import assign, components, external, families, labels, metrics, ordered, places, ranges, retrieval
from lodeweave.session import table
from lodeweave.sources import files, records


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_components(spark, limit):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(40)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)]
    df = spark.createDataFrame([*edges, (None, "x"), edges[0]], "a string, b string").repartition(4)
    got = {r.node: r.component for r in components.components(df, task_edges=limit).collect()}
    assert got == brute_components(edges)
    assert components.components(df.limit(0)).count() == 0


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(300), 2), (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    steps = sorted(set(p), reverse=True)
    ap, before = 0.0, 0.0
    for t in steps:
        tp, n = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        ap += (tp / y.sum() - before) * tp / n
        before = tp / y.sum()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    got = metrics.ranking_metrics(df).first()
    assert abs(got.ap - ap) < 1e-9 and abs(got.auroc - auc) < 1e-9
    one = metrics.ranking_metrics(df.filter("y = 0")).first()
    assert one.ap is None and one.auroc is None
    edges = [i / 15 for i in range(1, 15)]
    bins = np.searchsorted(edges, p, side="right")
    ece = sum((bins == b).mean() * abs(p[bins == b].mean() - y[bins == b].mean()) for b in set(bins))
    assert abs(metrics.calibration_error(df).first().ece - ece) < 1e-9


def test_nearest_against_matrix(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 8))
    df = spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(80)] + [(99, None, 0)], "id long, embedding array<double>, attr int").repartition(5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(df.filter("id % 10 = 0"), df, 4, within="attr").collect()}
    for q in range(0, 80, 10):
        order = sorted((j for j in range(80) if j != q and j % 3 == q % 3), key=lambda j: (-sims[q, j], j))[:4]
        assert [got[q, k + 1] for k in range(4)] == order


def test_overlap_join(spark):
    rng = random.Random(5)
    left = [(d, i, a, a + rng.randrange(150)) for i in range(40) for d in "xy" for a in [rng.randrange(400)]]
    right = [(d, i, a, a + rng.randrange(90)) for i in range(40) for d in "xy" for a in [rng.randrange(400)]]
    got = ranges.overlap_join(spark.createDataFrame(left, "k string, l int, l_start int, l_end int"), spark.createDataFrame(right, "k string, r int, r_start int, r_end int"), "k", 32)
    want = sorted((d, i, j, min(z, w) - max(a, b)) for d, i, a, z in left for e, j, b, w in right if d == e and min(z, w) - max(a, b) > 0)
    assert sorted((x.k, x.l, x.r, x.overlap) for x in got.collect()) == want


def test_adjacent_dedupe_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([(["abcdefghij", "abcdefghik", "abcdefghkl", "zzz"],)], "t array<string>")
    got = df.select(ordered.adjacent_dedupe(F.col("t"), 0.8).alias("x")).first().x
    assert got == ["abcdefghij", "abcdefghkl", "zzz"]
    assert df.select(ordered.adjacent_dedupe(F.lit(None).cast("array<string>")).alias("x")).first().x == []


def test_chunk_ranges(spark):
    df = spark.createDataFrame([([(0, 30), (30, 60), (60, 170), (170, 180)],)], "s array<struct<char_start:int,char_end:int>>")
    assert [tuple(r) for r in df.select(ordered.chunk_ranges(F.col("s"), 100).alias("x")).first().x] == [(0, 60), (60, 170), (170, 180)]


def test_fold_may_lose_explicitness(spark):
    rows = [(1, 1, True, "weak", "neg", "a"), (1, 2, False, "strong", "pos", "b")]
    got = ordered.strongest_mention(spark.createDataFrame(rows, "k int, pos int, explicit_fact_hit boolean, mention_strength string, polarity string, evidence_span string"), "k").first()
    assert (got.explicit_fact_hit, got.mention_strength) == (False, "strong")


def test_fold_by_chunks_is_the_fold(spark):
    """Composed from chunks of any size, NULL marks included."""
    rng = random.Random(9)
    rows = [(k, i, rng.choice([True, False, False, None]), rng.choice(["strong", "weak", "explicit", None]), "p", str(i)) for k in range(40) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "k int, pos int, explicit_fact_hit boolean, mention_strength string, polarity string, evidence_span string").repartition(5)
    want = {}
    for k, _, e, s, _, span in rows:
        if k not in want:
            want[k] = (e, s, span)
        else:
            a, b = want[k][:2]
            if (a is False and e is True) or (b is not None and b != "strong" and s == "strong"):
                want[k] = (e, s, span)
    for width in (1, 4, 1000):
        got = {r.k: (r.explicit_fact_hit, r.mention_strength, r.evidence_span) for r in ordered.strongest_mention(df, "k", chunk=F.floor(F.col("pos") / width)).collect()}
        assert got == want


def test_prototype_loss_falls_back(spark):
    rows = [(i, [1.0, float(i % 2)], i % 2, 0.5, "a") for i in range(8)] + [(20, [0.0, 1.0], 1, 0.5, "b"), (21, None, 0, 0.5, "b"), (22, [1.0, 0.0], 0, 0.01, "a")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, y int, c double, g string")
    got = {r.query_id: (r.level, r.loss) for r in retrieval.prototype_loss(df, df, "g", least=3, c_min=0.1, tau=1.0).collect()}
    assert got[0][0] == 0 and got[20][0] == 1 and 21 not in got and 22 not in got
    unit = np.array([1.0, 1.0]) / np.sqrt(2)
    assert got[0][1] == pytest.approx(0.5 * (np.log(np.exp(unit[0]) + np.exp(1.0)) - 1.0))
    assert retrieval.prototype_loss(df, df.filter("id < 0"), "g").count() == 0


def test_vectors_and_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, None), (3, [])], "id int, v array<float>")
    records.write_vectors(df, str(tmp_path / "v"), "v")
    assert sorted(map(tuple, records.read_vectors(spark, str(tmp_path / "v"), "v").collect())) == [(1, [0.5, -2.0]), (2, None), (3, [])]
    got = external.embedded(spark.createDataFrame([("ab",), (None,), ("",)], "text string"), external.stub_embedder).collect()
    assert [round(sum(x * x for x in r.embedding), 9) for r in got] == [1.0, 0.0, 0.0]


def test_decisions_with_unknown_targets_are_new(spark):
    said = {"aa": ("new", ""), "bb": ("merge", "nobody"), "ccc": ("merge", "bb"), "dddd": ("merge", "ccc")}
    got = families.sequential_merge(spark.createDataFrame([("g", n) for n in said], "category string, name string"), "category", lambda name, targets: said[name])
    assert {r.name: r.target for r in got.collect()} == {"aa": "aa", "bb": "bb", "ccc": "bb", "dddd": "dddd"}


def test_balanced_splits_follow_the_greedy_rule(spark):
    """Group by group, NULL labels as 0, rows without a group left out."""
    rng = random.Random(7)
    rows = [(f"r{g:02}", rng.choice([1, 0, 0, None])) for g in range(25) for _ in range(rng.choice([1, 2, 2, 5, 9]))]
    got = {r.g: r.split for r in assign.balanced_splits(spark.createDataFrame([*rows, (None, 1)], "g string, y int"), "g", "y").collect()}
    sizes = {g: (sum(1 for x, _ in rows if x == g), sum(y or 0 for x, y in rows if x == g)) for g, _ in rows}
    total, pos = len(rows), sum(y or 0 for _, y in rows)
    have, want = {k: [0, 0] for k in assign.SHARES}, {}
    for g, (n, p) in sorted(sizes.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        err = lambda k: sum(((have[s][0] + n * (s == k) - q * total) / max(1, q * total)) ** 2 + 2 * ((have[s][1] + p * (s == k) - q * pos) / max(1, q * pos)) ** 2 for s, q in assign.SHARES.items())  # noqa: B023, E731
        want[g] = min(have, key=err)
        have[want[g]][0] += n
        have[want[g]][1] += p
    assert got == want


def test_places_and_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.randrange(9), rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double").repartition(7)
    got = places.numbered(df, F.desc_nulls_last("v"), "id").collect()
    want = sorted(range(400), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert {r.id: r.place for r in got} == {i: k for k, i in enumerate(want, 1)}
    known = [v for v in values if v is not None]
    assert places.quantiles(df, "v", [0.0, 0.25, 0.5, 0.83, 1.0]).first().cut == pytest.approx(np.quantile(known, [0.0, 0.25, 0.5, 0.83, 1.0]).tolist())
    assert places.numbered(df.filter("id < 0"), "id").count() == 0 and places.quantiles(df.filter("id < 0"), "v", [0.5]).first().cut in (None, [])
    assert places.quantiles(df.filter("v is not null").limit(1), "v", [0.3]).count() == 1


@pytest.mark.parametrize("query_rows, library_rows, strip", [(20_000, 100_000, 1000), (3, 7, 2)])
def test_cells_lose_nothing(spark, monkeypatch, query_rows, library_rows, strip):
    """Neighbours, threshold pairs and sums are the same however queries and library are cut."""
    for name, n in (("QUERY_ROWS", query_rows), ("LIBRARY_ROWS", library_rows), ("STRIP", strip)):
        monkeypatch.setattr(retrieval, name, n)
    rng = np.random.default_rng(4)
    m, other = rng.normal(size=(60, 6)), rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, m[i].tolist(), other[i].tolist(), "a" if i % 4 else None, str(i % 3)) for i in range(60)], "id long, embedding array<double>, second array<double>, block string, kind string").repartition(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s, t = np.round(unit(m) @ unit(m).T, 6), np.round(unit(other) @ unit(other).T, 6)
    asked = df.filter("id < 20")
    far = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(asked, df, 3, hardest=True).collect()}
    mark = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(asked, df, 3, bonus=0.5, mark="kind").collect()}
    inside = {(r.query_id, r.id) for r in retrieval.nearest(asked, df, 100, within="block").collect()}
    for q in range(20):
        rest = [j for j in range(60) if j != q]
        assert [far[q, k + 1] for k in range(3)] == sorted(rest, key=lambda j: (s[q, j], j))[:3]
        assert [mark[q, k + 1] for k in range(3)] == sorted(rest, key=lambda j: (-(s[q, j] + 0.5 * (j % 3 == q % 3)), j))[:3]
    assert inside == {(q, j) for q in range(20) for j in range(60) if q != j and q % 4 and j % 4}
    pairs = retrieval.pairs_where(asked, df, ["embedding", "second"], lambda x: (x[0] >= 0.2) & (x[1] < 0.1))
    assert {(r.query_id, r.id) for r in pairs.collect()} == {(q, j) for q in range(20) for j in range(60) if q != j and s[q, j] >= 0.2 and t[q, j] < 0.1}
    sums = {r.query_id: r.total for r in retrieval.kernel_sums(asked, df, np.exp).collect()}
    assert sums == pytest.approx({q: sum(np.exp((unit(m) @ unit(m).T)[q, j]) for j in range(60) if j != q) for q in range(20)})
    assert retrieval.nearest(asked.filter("id < 0"), df, 3).count() == 0 and retrieval.nearest(asked, df.filter("id < 0"), 3).count() == 0


def test_label_edges(spark):
    schema = "sample_id long, split string, reviews array<struct<review_id:string,text:string,polarity:string,mention_strength:string,explicit_fact_hit:boolean,review_time:string,relation:string>>"
    r = lambda rel, pol, txt="t", time=None, ex=False: ("r", txt, pol, "strong", ex, time, rel)
    rows = [(1, "train", None), (2, "train", []), (3, "train", [r("support", "pos")] * 4), (4, "train", [r("refute", "neg", ex=True), r(None, "pos")])]
    df = labels.aligned_reviews(spark.createDataFrame(rows, schema))
    got = {x.sample_id: x for x in labels.label_weights(df, "aligned", "total").collect()}
    assert (got[1].y_new, got[1].c_new) == (0, 0.05) and got[2].n_total == 0
    assert got[3].suspected_fake and got[4].y_new == 1
    second = {x.sample_id: x.y_new for x in labels.label_weights(df, "aligned", "total", labels.L2).collect()}
    assert second[1] is None and second[4] == 1


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert len(set(families.average_linkage(d, 0.2))) == 2 and len(set(families.average_linkage(d, 0.9))) == 1


def test_greedy_representatives(spark):
    got = families.greedy_representatives(spark.createDataFrame([("c", "abcde"), ("c", "abcdef"), ("c", "xyz"), ("c", None)], "category string, phrase string"), "category", 0.8)
    assert {(r.phrase, r.representative) for r in got.collect()} == {("abcde", "abcde"), ("abcdef", "abcde"), ("xyz", "xyz")}


def test_salvage():
    import pandas as pd

    given = ['{"a": 1}', 'so ```json\n{"a": 1}\n``` end', 'x {"a": "}"} y', '[{"a": 1}, {"b": "]"}, {"c":', "none", None]
    assert [json.loads(x) if x else x for x in next(families.salvaged(iter([pd.Series(given)])))] == [{"a": 1}, {"a": 1}, {"a": "}"}, [{"a": 1}, {"b": "]"}], None, None]


def test_errors_become_rows(spark):
    def client(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    got = {r.key: (r.response, r.error) for r in external.call_many(spark.createDataFrame([("1", "ok"), ("2", "bad")], "key string, request string"), client).collect()}
    assert got == {"1": ("OK", None), "2": (None, "ValueError: no")}


def test_records(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, "中"), (2, None)], "a int, b string")
    assert records.read_records(spark, path, df.schema).count() == 0
    assert records.write_records(df, path) == 2 and records.write_records(df.limit(1), path, append=True) == 1
    assert records.read_records(spark, path, df.schema).count() == 3
    (tmp_path / "log").write_text('x\nRESULT {"k": 3}\n')
    assert records.read_marked(spark, str(tmp_path / "log"), "k int").first().k == 3


def test_subtitles_and_sheets(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,500\n你好\n世界\n\n2\nno time\n\n3\n00:00:03.000 --> 00:00:04.000\n再见\n".encode("gb18030"))
    got = [(r.idx, r.start_ts, r.text) for r in files.read_subtitles(spark, str(tmp_path / "*.srt")).orderBy("idx").collect()]
    assert got == [(0, "00:00:01,000", "你好 世界"), (1, "00:00:03.000", "再见")]
    (tmp_path / "s.xls").write_text("<table><tr><th>评论内容</th><th>评论情感</th></tr><tr><td> 好 </td><td>好评</td></tr><tr><td></td><td>差评</td></tr><tr><td>行</td><td>?</td></tr></table>")
    rows = files.read_review_sheets(spark, str(tmp_path / "s.xls")).collect()
    assert [(r.comment_id, r.text, r.polarity) for r in rows] == [("s#0", "好", "pos"), ("s#2", "行", "neu")]
    (tmp_path / "empty.xls").write_bytes(b"")
    (tmp_path / "bad.xls").write_bytes(b"PK\x03\x04 no workbook")
    (tmp_path / "none.xls").write_bytes(b"no table")
    told = {r.comment_id: r.error for r in files.read_review_sheets(spark, str(tmp_path / "*.xls"), strict=False).filter("error is not null").collect()}
    assert set(told) == {"bad", "none"}
    with pytest.raises(Exception, match="neither a spreadsheet nor an HTML table"):
        files.read_review_sheets(spark, str(tmp_path / "none.xls")).collect()


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    records.append_missing(df, path, "k")
    records.append_missing(df.unionByName(spark.createDataFrame([(3,)], "k int")), path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_pairs_of_containment(spark):
    rows = [(1, "p", "abcdef"), (2, "p", "xabcdefx"), (3, "p", "abc"), (4, "q", "abcdef"), (5, "p", None), (6, "p", "ABC def"), (7, None, "abcdef"), (8, "p", "bcdefx"), (9, "r", "zzzzzz"), (10, "r", "zzzzz")]
    df = spark.createDataFrame(rows, "id long, product string, text string")
    assert sorted((r.a, r.b) for r in families.containment_pairs(df, ["product"]).collect()) == [(1, 2), (2, 8), (9, 10)]
    assert {r.id: (r.family, r.size) for r in families.claim_families(df, ["product"]).collect()} == {1: (1, 4), 2: (1, 4), 6: (1, 4), 8: (1, 4), 9: (9, 2), 10: (9, 2)}
    none = df.filter("id < 0")
    assert families.containment_pairs(none, ["product"]).count() == 0 and families.claim_families(none, ["product"]).count() == 0


@pytest.mark.parametrize("few", [0, 30, 1000])
def test_containment_against_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(families, "FEW", few)
    rng = random.Random(11)
    rows = [(i, rng.choice("pq"), "".join(rng.choice("ab") for _ in range(rng.randrange(3, 14)))) for i in range(120)]
    first = {}
    for i, p, t in rows:
        first.setdefault((p, t), i)
    want = {(min(i, j), max(i, j)) for (p, t), i in first.items() for (q, u), j in first.items() if p == q and t != u and len(t) >= 5 and t in u}
    assert {(r.a, r.b) for r in families.containment_pairs(spark.createDataFrame(rows, "id long, product string, text string"), ["product"]).collect()} == want


def test_kept_claims(spark):
    f = spark.createDataFrame([(i, fam, 2) for i, fam in ((1, 1), (2, 1), (3, 3), (4, 3))], "id long, family long, size long")
    facts = [(1, "描述", 9, 9, 1, "z"), (2, "<材质>", 1, 0, 1, "a"), (3, "色", 1, 1, 0, "a"), (4, "色", None, 5, 1, None)]
    got = {r.id: (r.conflict, r.kept, r.demoted) for r in families.kept_claims(f, spark.createDataFrame(facts, "id long, attribute string, n_sources int, n_aligned int, y int, pair_id string")).collect()}
    assert got == {1: (False, 2, True), 2: (False, 2, False), 3: (True, 3, True), 4: (True, 3, True)}


def test_many_names_are_matched_without_a_nested_loop(spark):
    keys = spark.createDataFrame([(k,) for k in ("净含量", "含量", "颜色", "色", "ab", None, "")], "param_key string")
    names = spark.createDataFrame([(str(i), n) for i, n in enumerate(("含量", "净 含量", "颜色分类", "b", "色", None))], "attribute_id string, name string")
    few, many = (sorted(map(tuple, families.alias_matches(keys, names, most).collect())) for most in (100, 2))
    assert few == many and len(few) > 5


def test_reports(spark, tmp_path):
    from lodeweave.sources import reports

    df = spark.createDataFrame([(2, "a|b"), (1, None)], "k int, v string")
    assert reports.markdown(df, ["k"]).splitlines()[2:] == ["| 1 |  |", "| 2 | a\\|b |"]
    assert "More than 1 rows." in reports.markdown(df, ["k"], most=1)
    for value in ({"old": 1}, {"中": 1}):
        reports.write_document(spark, str(tmp_path / "d/x.json"), value)
    assert records.read_document(spark, str(tmp_path / "d/x.json"), "`中` int").first()[0] == 1
    assert [f.name for f in (tmp_path / "d").iterdir() if not f.name.endswith(".crc")] == ["x.json"]
    (tmp_path / "i.jpg").write_bytes(b"abc")
    assert reports.data_urls(spark.read.format("binaryFile").load(str(tmp_path / "i.jpg"))).first().url == "data:image/jpeg;base64,YWJj"
    df.write.parquet(str(tmp_path / "t"))
    sizes = reports.slimmed(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"])
    assert spark.read.parquet(str(tmp_path / "u")).columns == ["k"] and 0 < sizes["after"] < sizes["before"]
    with pytest.raises(ValueError):
        reports.slimmed(spark, str(tmp_path / "t"), str(tmp_path / "t"), ["k"])


def test_calls_keep_their_order_and_run_at_once(spark):
    import time as clock

    def client(text):
        clock.sleep(0.05)
        return text

    df = spark.createDataFrame([(str(i), f"r{i}") for i in range(40)], "key string, request string").coalesce(1)
    began = clock.time()
    assert [(r.key, r.response) for r in external.call_many(df, client, concurrency=20).collect()] == [(str(i), f"r{i}") for i in range(40)]
    assert clock.time() - began < 40 * 0.05 + 5


def test_unknown_policy_is_an_error(spark):
    from lodeweave.plans.evidence import PLANS

    sql = PLANS["policy_evidence"].sql.replace("'vlm_only', 'args_only')", "'vlm_only', 'nonsense')")
    assert sql != PLANS["policy_evidence"].sql
    with pytest.raises(Exception, match="unknown evidence policy: nonsense"):
        spark.sql(sql, samples=table(spark, "/root/testdata/sf0.001", "samples")).collect()


def test_sequential_merge(spark):
    df = spark.createDataFrame([("c", "ab"), ("c", "abc"), ("c", "xyz"), ("c", "ab")], "category string, name string")
    assert {(r.name, r.target) for r in families.sequential_merge(df, "category").collect()} == {("ab", "ab"), ("abc", "ab"), ("xyz", "xyz")}


def test_deficit_splits(spark):
    rows = [(f"r{g}",) for g, n in enumerate([7, 2, 1]) for _ in range(n)] + [(None,)]
    got = {r.g: r.split for r in assign.deficit_splits(spark.createDataFrame(rows, "g string"), "g").collect()}
    assert got == {"r0": "train", "r1": "test", "r2": "val"}
    assert assign.deficit_splits(spark.createDataFrame([], "g string"), "g").count() == 0
