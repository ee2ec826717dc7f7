"""What packages have in common is worked out once, and nothing is shredded that was not asked for."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators.extract import Corpus
from quire.sources import package
from quire.sources.builder import build, make_packages
from quire.sources.shred import Package


def _one(text):
    return {"blocks": [{"runs": [{"t": text}]}]}


def test_styles_of_equal_packages_are_parsed_once():
    a, b = (Package(package.load(package.zip_parts(build(_one(t))))) for t in ("x", "y"))
    assert a.root("word/styles.xml") is b.root("word/styles.xml")
    assert a.root("word/document.xml") is not b.root("word/document.xml")
    assert a.root("word/_rels/document.xml.rels") is b.root("word/_rels/document.xml.rels")


def test_archives_are_those_of_zipfile():
    parts = [("a.xml", b"<a/>" * 100), ("ü/b.bin", bytes(range(256)) * 300), ("c", b"")]
    made = package.zip_parts(parts)
    assert made == package._zip_large(parts) and package.unzip(made) == parts
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as z:
        for name, body in parts:
            z.writestr(name, body)
    assert package.unzip(stored.getvalue()) == parts
    # a damaged entry is not read as if it were whole
    at = made.index(b"a.xml") + 5
    with pytest.raises(Exception):  # noqa: B017, PT011
        package.unzip(made[:at] + b"\xff" + made[at + 1 :])


def test_elements_of_styles_are_made_on_demand(spark):
    c = Corpus(make_packages(spark.range(3).withColumnRenamed("id", "doc_id"), lambda row: _one("x")))
    own = c.node_elements(styles=False)
    assert {r["role"] for r in own.select("role").distinct().collect()} == {"main"} and set(c._stored) == {"elements"}
    assert {r["role"] for r in c.node_elements().select("role").distinct().collect()} == {"main", "styles"}


def test_edited_packages_are_made_once(spark):
    # what is left in the plan are the edit and the search for words, over stored parts
    from quire.queries import QUERIES

    plan = QUERIES["signed_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_equal_packages_are_written_and_shredded_once(spark):
    from quire.sources import builder, shred

    assert builder.packed(_one("equal")) is builder.packed(_one("equal")) != builder.packed(_one("other"))
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"))
    c = Corpus(make_packages(docs, lambda row: _one("even" if row["doc_id"] % 2 == 0 else f"odd {row['doc_id']}")))
    got = {r["doc_id"]: r["text"] for r in c.shred("inlines").inlines.collect()}
    assert got == {k: "even" if k % 2 == 0 else f"odd {k}" for k in range(40)}
    # rows of equal packages are held once, each document with its own
    held, kept, rows = shred._Held(), shred._Kept(), [("a",), ("b",)]
    kept.put(b"x", {"t": rows})
    for k, found in enumerate((kept.get(b"x")["t"], [("c",)], kept.get(b"x")["t"], [])):
        held.add(k, found)
    ids, at = held.dealt()
    assert len(held.rows) == 3 and ids.to_pylist() == [0, 0, 1, 2, 2] and [held.rows[k][0] for k in at.to_pylist()] == ["a", "b", "c", "a", "b"]
