"""The sample of labelled texts is bounded and one row an id, whatever repeats ids."""

from quire.llm import quality


def test_repeated_ids_are_one_row(spark):
    docs = spark.range(5000).selectExpr("7L doc_id", "concat('text number ', id) text").unionByName(spark.createDataFrame([(8, "another text"), (9, None), (None, "none")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1), (8, 1), (9, 0), (None, 0), (10, None)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, 100)
    assert len(rows) == 3 and sum(r["bad"] for r in rows) == 2
    assert rows == quality.labelled_sample(docs.repartition(7), labels.repartition(3), 100)


def test_no_labels_no_rules(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in quality.quality(docs, labels).collect()] == [True]
