"""Operators that SQL can express: the same rows as the SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cipherlode.llm import registry, urls, warc


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{table}')")
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no-scheme.com/x"), (4, "HTTP://WWW.Example.COM/en/a?q#f"), (5, "http://a.net/es/"), (6, "http://net/fr/x"), (7, "x://"), (None, "http://a.com/"), (4, "http://notcom/")]
    got = {(r.page_id, r.host, r.path, r.rule) for r in urls.verdicts(spark.createDataFrame([(i, u, "x", 0) for i, u in rows], "page_id long, url string, host string, g int")).collect()}
    assert {(1, "", "", None), (3, "", "", None), (4, "www.example.com", "/en/a", "www.example.com/en/"), (5, "a.net", "/es/", "net/es/"), (6, "net", "/fr/x", "net/fr/"), (7, "", "", None), (None, "a.com", "/", "com/"), (4, "notcom", "/", None)} <= got
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_classifier_learns(spark):
    """The table it learns from, without rules, and hosts of the same kind that it never saw."""
    right = lambda rows: urls.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).agg(F.avg(((F.col("verdict") == "block") == (F.col("page_id") == 1)).cast("int"))).first()[0]
    assert right(list(urls.LABELLED)) >= 0.95
    new = [(1, "http://cheap-casino.net/win"), (1, "https://pills-spam.org/cheap"), (1, "http://free-pills.net/buy"), (0, "https://www.museum.org/en/courses/3"), (0, "https://news.garden.net/fr/report"), (0, "https://docs.library.org/de/guide")]
    assert right(new) >= 5 / 6


def test_fixity_of_odd_replicas(spark):
    kind = "key long, record string"
    good = [(i, f"r{i}") for i in range(3000)] + [(None, "n"), (7, "again"), (-5, "low")]
    bad = [(i, r) for i, r in good if i != 12] + [(9000, "new"), (None, "n2")]
    bad[100] = (bad[100][0], "damaged")
    got = {(r.key, r.status) for r in warc.audit(spark.createDataFrame(good, kind), spark.createDataFrame(bad, kind)).collect()}
    assert got == {(12, "missing"), (9000, "extra"), (bad[100][0], "changed"), (None, "changed")}
    assert warc.audit(spark.createDataFrame(good, kind), spark.createDataFrame(good[::-1], kind)).count() == 0
    assert warc.audit(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0
