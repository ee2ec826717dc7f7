"""Edits by bytes: whatever the prefix, what is not edited stays; relationships, dates and faults at their edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import edit, resources, splice
from quire.operators.extract import Corpus
from quire.plans import annotations, tree
from quire.sources import xml
from quire.sources.builder import make_packages

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_spans_are_exact():
    data = f'<?xml version="1.0"?>\n<x:document xmlns:x="{W}" a=">"><!-- <b> --><x:body><x:p/><x:p ><x:r><x:t>ä &lt;</x:t></x:r></x:p ></x:body></x:document>'.encode()
    found = xml.spans(data)
    assert [e.qname for e in found] == ["x:document", "x:body", "x:p", "x:p", "x:r", "x:t"]
    assert [data[e.start : e.end].decode() for e in found[2:4]] == ["<x:p/>", "<x:p ><x:r><x:t>ä &lt;</x:t></x:r></x:p >"]
    assert data[found[5].inner_start : found[5].inner_end].decode() == "ä &lt;" and found[5].text == "ä <" and found[2].inner_start is None
    assert [(e.first, e.last, e.parent, e.place) for e in found] == [(0, 5, None, 0), (1, 5, 0, 0), (2, 2, 1, 0), (3, 5, 1, 1), (4, 5, 3, 0), (5, 5, 4, 0)]
    for bad in (b"<a>", "<a/>".encode("utf-16"), b'<?xml version="1.0" encoding="ISO-8859-1"?><a/>', b"<!DOCTYPE a><a/>"):
        with pytest.raises(ValueError):
            xml.spans(bad)


def part(inner, prefix="q"):
    return f'<{prefix}:p xmlns:{prefix}="{W}">{inner}</{prefix}:p>'.encode()


def test_replacement_follows_the_namespace():
    new, found = edit.replace_in_part(part('<q:r><q:t>old &amp; old</q:t></q:r><w:t xmlns:w="other">old</w:t>'), {"old": "<new>"})
    assert found == {"old": 2} and b"<q:t>&lt;new&gt; &amp; &lt;new&gt;</q:t>" in new and b'xmlns:w="other">old</w:t>' in new


def test_what_is_apart_is_not_found_together():
    run = lambda x: f"<q:r>{x}</q:r>"
    t = lambda x: f"<q:t>{x}</q:t>"
    assert edit.replace_across_runs(part(run(t("a") + "<q:tab/>" + t("b"))), "ab", "x")[1] == 0
    assert edit.replace_across_runs(part(run(t("a")) + run("<q:rPr/>" + t("b"))), "ab", "x") == (part(run(t("x")) + run("<q:rPr/>" + t(""))), 1)
    box = run("<q:pict><q:p>" + run(t("ab")) + "</q:p></q:pict>")
    assert edit.replace_across_runs(part(run(t("c")) + box + run(t("ab"))), "ab", "x")[1] == 2


def corpus(spark, *documents):
    return Corpus(make_packages(spark.createDataFrame([(k,) for k in range(len(documents))], "doc_id long"), lambda row: documents[row["doc_id"]]))


def test_overlapping_edits_are_an_error(spark):
    c = corpus(spark, {"blocks": [{"runs": [{"t": "abc"}]}]})
    e = c.node_elements().filter("role = 'main'")
    both = splice.remove(e.filter("kind = 'Paragraph'")).unionByName(splice.remove(e.filter("kind = 'Run'")))
    assert splice.clashes(both).count() == 1
    with pytest.raises(Exception, match="overlap"):
        splice.apply(c.parts, both).filter("role = 'main'").select(F.length("content")).collect()
    inner_is_dropped = splice.remove(e.filter("kind in ('Paragraph', 'Run')"))
    assert inner_is_dropped.count() == 1


def test_untouched_parts_stay(spark):
    c = corpus(spark, {"blocks": [{"runs": [{"t": "abc"}]}]})
    e = c.node_elements().filter("role = 'main'")
    out = splice.apply(c.parts, splice.append(e.filter("kind = 'Paragraph'"), F.lit("<w:r/>")))
    before = {r["part_name"]: r["sha256"] for r in c.parts.collect()}
    after = {r["part_name"]: (r["sha256"], r["edited"]) for r in out.collect()}
    assert {n for n in before if before[n] != after[n][0]} == {"word/document.xml"} == {n for n, (_, k) in after.items() if k}


def test_descendants_cross_bins(spark, monkeypatch):
    monkeypatch.setattr(tree, "BIN", 4)
    c = corpus(spark, {"blocks": [{"table": [[{"t": "a"}, {"blocks": [{"runs": [{"t": "b"}]}, {"table": [[{"t": "c"}]]}, {"runs": []}]}]]}, {"runs": [{"t": "d"}] * 5}]})
    e = c.node_elements().filter("role = 'main'")
    rows = {r["first"]: r for r in e.collect()}
    pairs = {(r["node"], r["descendant"]) for r in tree.descendants(e, e.filter("kind in ('Table', 'Body')")).collect()}
    want = set()
    for d in rows.values():
        up = d["parent"]
        while up is not None:
            if rows[up]["kind"] in ("Table", "Body") and not d["property"]:
                want.add((up, d["first"]))
            up = rows[up]["parent"]
    assert pairs == want and len(want) > 30
    nearest = {r["node"]: r["ancestor"] for r in tree.ancestors(e, e.filter("kind = 'Table'"), "Cell").filter("up = 1").collect()}
    assert len(nearest) == 1


def test_free_numbers_fill_gaps(spark):
    rel = spark.createDataFrame([(1, "p", "rId1", "t", "a", True, 0), (1, "p", "rId3", "t", "b", True, 1), (1, "p", "other", "t", "c", True, 2)], "doc_id long, owner_part string, rid string, type_uri string, target string, external boolean, ord int")
    wanted = spark.createDataFrame([(1, "p", "t", x, True) for x in "bdefd"] + [(2, "p", "t", "a", True)], "doc_id long, owner_part string, type_uri string, target string, external boolean")
    got = {(r["doc_id"], r["target"]): (r["rid"], r["new"]) for r in resources.allocate(rel, wanted).collect()}
    assert got == {(1, "b"): ("rId3", False), (1, "d"): ("rId2", True), (1, "e"): ("rId4", True), (1, "f"): ("rId5", True), (2, "a"): ("rId1", True)}


def test_last_relationship_wins_in_order_of_code_units(spark):
    rel = spark.createDataFrame([(1, "p", r, "t", "u", f"x{k}", False, "main", k) for k, r in enumerate(["b", "a", "b", "\U0001d400", "�", ""])], "doc_id long, owner_part string, rid string, rel_type string, type_uri string, target string, external boolean, owner_role string, ord int")
    got = [(r["rid"], r["target"]) for r in annotations.selected_relationships(rel).orderBy("rank").collect()]
    assert got == [("a", "x1"), ("b", "x2"), ("\U0001d400", "x3"), ("�", "x4")]


@pytest.mark.parametrize("raw,wall,zone", [
    ("2024-05-01", (2024, 5, 1), None), ("2024-05-01T01:02:03", (2024, 5, 1, 1, 2, 3), None), ("2024-05-01t01:02:03z", (2024, 5, 1, 1, 2, 3), 0), ("2024-05-01 01:02:03+0130", (2024, 5, 1, 1, 2, 3), 90),
    ("2024-05-01T01:02:03-5", (2024, 5, 1, 1, 2, 3), -300), ("2024-05-01T01:02:03-130", (2024, 5, 1, 1, 2, 3), -90), ("2024-05-01T01:02:03.99999999Z", (2024, 5, 1, 1, 2, 4), 0), ("2024-05-01T24:00:00", None, None),
    ("2024-05-01T01:02:03+14:00", (2024, 5, 1, 1, 2, 3), 840), ("2024-05-01T01:02:03+14:01", None, None), ("2024-05-01T01:02:03+01:60", None, None), ("2024-05-01T01:02", None, None), ("2024-02-30", None, None), ("x", None, None), ("", None, None),
    ("2024-05-01T01:02:03.", None, None), ("2024-05-01T01:02:03+", None, None)])
def test_dates_of_comments(spark, raw, wall, zone):
    got = spark.range(1).select(annotations.parsed_date(F.lit(raw)).alias("p")).first()["p"]
    assert (None if got is None else (got["wall"], got["zone"])) == (None if wall is None else (datetime.datetime(*wall), zone))


def test_a_reading_that_comes_twice_is_of_standard_time(spark):
    at = lambda h: spark.range(1).select(annotations.from_zone(F.lit(datetime.datetime(2024, 10, 27, h, 30)).cast("timestamp_ntz"), "Europe/Berlin").alias("x")).first()["x"].hour
    assert (at(1), at(2), at(3)) == (23, 1, 2)
