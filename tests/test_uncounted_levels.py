"""A place in a label for a level that has not counted is told apart from one that has."""

import duckdb

from quire.plans import resolve


def test_uncounted_levels_are_named(spark):
    items = spark.createDataFrame([(1, [0], 1, 1), (1, [1], 1, 0), (1, [2], 1, 1), (1, [3], 2, 0)], "doc_id long, path array<int>, list_id int, level int")
    levels = spark.createDataFrame([(1, 1, 0, 0, "%1.", 1), (1, 1, 1, 0, "%1.%2", 1), (1, 2, 0, 3, "%1%2", 1)], "doc_id long, list_id int, level int, number_style int, number_format string, start_at int")
    got = {r["path"][0]: (r["label"], r["uncounted"]) for r in resolve.list_labels(items, levels).collect()}
    assert got == {0: ("0.1", [0]), 1: ("1.", []), 2: ("1.1", []), 3: ("A", [1])}


def test_the_query_gives_labels_as_they_are(spark):
    from __spark_entry__ import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    got = queries()["label_edge_cases"](spark, d)
    rel = duckdb.sql(oracle_sql()["label_edge_cases"].replace("FROM part", f"FROM '{d}/part.parquet'"))
    rows = [tuple(r) for r in got.select(*rel.columns).collect()]
    assert sorted(rows) == sorted(rel.fetchall()) and "A0" in {r[2] for r in rows}
