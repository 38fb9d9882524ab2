"""Every query of the subpackage runs on the smallest data, with the stated columns."""

import glob
import os

import duckdb
import pytest

from lodeweave.llm import queries as Q

COLUMNS = {
    "p1_found": ["product_id"], "p2_found": ["sample_id", "field_name", "item_no"], "p3_found": ["sample_id", "field_name", "item_no"], "p5_found": ["sample_id_a", "sample_id_b", "field_name"],
    "p6_found": ["review_id_a", "review_id_b"], "p9_found": ["doc_id", "lang_code"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    df = Q.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        assert df.count() > 0


def test_groups_and_pairs_agree(spark, data):
    pairs = Q.p6_found(spark, data).collect()
    groups = {r.review_id: r for r in Q.p6_groups(spark, data).collect()}
    links = {}
    for r in pairs:
        for x in r:
            links[x] = links.get(x, 0) + 1
        assert groups[r.review_id_a].group_key == groups[r.review_id_b].group_key
    assert {k: r.n_links for k, r in groups.items()} == links


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df, r = Q.queries()[name](spark, data), con.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    plain = lambda v: round(float(v), 9) if isinstance(v, (int, float)) else v
    assert sorted(str([plain(x[c]) for c in columns]) for x in df.collect()) == sorted(str([plain(dict(zip(r.columns, x))[c]) for c in columns]) for x in r.fetchall())


def test_coverage_and_report_agree_with_the_pairs(spark, data):
    pairs = Q.p5_found(spark, data).collect()
    rows = Q.p5_coverage(spark, data).collect()
    report = Q.p5_report(spark, data).collect()
    assert sum(r.train_rows for r in rows) == len(pairs) == sum(r.pairs for r in report)
    assert len(rows) == sum(r.eval_rows for r in report) and all(0 < r.coverage <= 1 and r.similarity >= 0.6 for r in rows)
