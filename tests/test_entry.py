import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = entry.queries()[name](spark, small), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_that_share_a_url(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select * from (values (1::bigint, 'http://a#x', ''), (2, 'http://a#x', ''), (4, 'http://a#x', ''), (5, NULL, ''), (6, 'http://b', '')) t(page_id, url, html)) to '{tmp_path}/pages.parquet'")
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    got, want = entry.queries()["u5_articles"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["u5_articles"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name, most", [("u7_reset_orphans", 8), ("u4_provenance", 50)])
def test_lines_are_dealt_once_for_what_joins_by_article(spark, small, name, most):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") <= most
