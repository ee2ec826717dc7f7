"""Work on many packages is dealt to many tasks, and nothing that grows with them goes to every task or to the driver."""

import re

from pyspark.sql import functions as F

from quire.operators.extract import Corpus
from quire.plans import resolve
from quire.sources.builder import PER_TASK, TASK_BYTES, make_packages, spread, tasks_for


def _items(row):
    return {"lists": [[{"fmt": "decimal", "text": "%1."}]], "blocks": [{"num": 1, "runs": [{"t": "x"}]}]}


def test_rows_of_one_partition_are_dealt(spark):
    few = spark.range(3).withColumnRenamed("id", "doc_id").coalesce(1)
    many = spark.range(5000).withColumnRenamed("id", "doc_id").coalesce(1)
    assert few.transform(spread).rdd.getNumPartitions() == 1
    made = make_packages(many, _items).select(F.spark_partition_id().alias("p"))
    counts = [r["count"] for r in made.groupBy("p").count().collect()]
    assert sum(counts) == 5000 and len(counts) >= 4 and max(counts) < 2500
    # a task's share does not grow with the rows
    large = spark.range(40 * PER_TASK).withColumnRenamed("id", "doc_id").coalesce(1)
    assert spread(large).rdd.getNumPartitions() >= 40


def test_node_tables_are_not_broadcast(spark):
    c = Corpus(make_packages(spark.range(50).withColumnRenamed("id", "doc_id"), _items))
    plan = c.labels()._jdf.queryExecution().toString()
    plan += resolve.header_assignment(c.section_references, c.relationships)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and not re.search("Broadcast(HashJoin|Exchange)", plan)


def test_node_tables_are_joined_where_they_are(spark):
    # a join by document and more moves no rows, so that a task has a bucket of documents however well equal rows pack
    from quire.queries import QUERIES

    plan = QUERIES["style_chain_depth"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "SortMergeJoin" in physical and "Exchange" not in physical


def test_what_is_made_of_node_tables_is_not_broadcast(spark):
    # a row a document, made by joins, is as long as the node tables are: the hint on these does not reach it
    from __spark_entry__ import queries

    for name in ("merged_tab_stops", "text_space", "style_lookup", "crossed_ranges", "flat_opc_roundtrip", "docx_roundtrip"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        physical = plan[plan.index("Physical Plan") :]
        assert "SortMergeJoin" in physical and not re.search("Exchange", physical), name


def test_orders_are_not_broadcast(spark):
    from quire.queries import _order_lists

    plan = _order_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_texts_are_dealt_to_more_tasks(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 40_000).alias("text"))
    assert tasks_for(docs) == -(-5000 * 40_000 // TASK_BYTES) > tasks_for(docs.select("doc_id"))
