"""Queries over documents on texts that are odd: none, blank lines, carriage returns."""

import duckdb
import pytest

ODD = [(1, "the a\n\nthe b"), (2, ""), (3, None), (4, "\nthe lead"), (5, "the tail\n"), (6, "the\rcr the\r\nx"), (7, "tab\tthe \t"), (8, "\n\n"), (9, '<the> & "the" &amp;'), (10, "e t\ne the t e the")]


@pytest.mark.parametrize("name", ["replace_count", "replace_over_runs", "hidden_text"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    from quire.queries import ORACLES, QUERIES

    spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())
