"""Plans of many joins are made in steps: a task holds a page of memory for each sort of its stage, whatever its rows."""

import pytest

from quire.operators.extract import Corpus

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cell_fonts", "painted_cell_fonts", "exported_stories"])
def test_a_stage_has_few_sorts(spark, monkeypatch, name):
    from __spark_entry__ import queries

    sorts = {}
    count = lambda df: max(part.count("Sort [") for part in df._jdf.queryExecution().executedPlan().toString().split("Exchange "))
    settled = Corpus.settled
    monkeypatch.setattr(Corpus, "settled", lambda self, df, step: sorts.update({step: count(df)}) or settled(self, df, step))
    sorts[name] = count(queries()[name](spark, D))
    assert max(sorts.values()) <= 12 and sorts[name] <= 8, sorts
