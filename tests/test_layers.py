"""Layers of formats, text as styles make it, links in text: rules at their edges, on hand-made rows and packages."""

import re
import string

import pytest
from pyspark.sql import functions as F

from quire.functions import links
from quire.operators.extract import Corpus
from quire.plans import cascade
from quire.sources.builder import make_packages
from quire.sources.package import INPUT_BYTES  # noqa: F401  the limit that a missing content stands for


def corpus(spark, *documents):
    return Corpus(make_packages(spark.createDataFrame([(k,) for k in range(len(documents))], "doc_id long"), lambda row: documents[row["doc_id"]]))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- links
@pytest.mark.parametrize("text,want", [
    ("", [("", None)]), ("plain", [("plain", None)]), ("[a](b)", [("a", "b")]), ("![a](b)", [("![a](b)", None)]), ("[]()", [("[]()", None)]), ("[a]()", [("a", "")]),
    ("x [a](b) y", [("x ", None), ("a", "b"), (" y", None)]), ("[a [b](c)", [("[a ", None), ("b", "c")]), ("[a](x[b](y)", [("[a](x", None), ("b", "y")]),
    ("[a](b(c d)e)", [("a", "b(c d)e")]), ("[a](b(c(d))", [("[a](b(c(d))", None)]), ("[a](<b c> 'title')", [("a", "b c")]), ("[a](<b)", [("a", "<b")]), ("[a](b \"t)", [("[a](b \"t)", None)]),
    ("[a\\]](b\\&c)", [("a]", "b&c")]), ("[a\\\n](b)", [("[a\\\n](b)", None)]), ("[a](b c)", [("[a](b c)", None)])])
def test_links_are_found(text, want):
    assert list(links.found(text)) == want


def test_links_survive_writing(spark):
    labels = ["x", string.punctuation, "a\tb", "ü]"]
    targets = ["http://h/?a=1&b", "a(b)c", "a\\b", "", "one two", "(", "a b(c)"]
    df = spark.createDataFrame([(a, b) for a in labels for b in targets], "label string, target string").withColumn("s", links.segments(links.markup(F.col("label"), F.col("target"))))
    for r in df.collect():
        assert [(x["text"], x["url"]) for x in r["s"]] == [(r["label"], r["target"])]
    assert one(spark, links.segments(F.lit(None).cast("string"))) is None


# ---------------------------------------------------------------- hidden text and capitals
def test_hidden_runs_by_style(spark):
    styles = [{"id": "Normal", "name": "Normal", "default": True, "hidden": True}, {"id": "P", "name": "P", "hidden": True}, {"id": "C", "name": "C", "kind": "character", "hidden": True}, {"id": "S", "name": "S", "kind": "character", "hidden": False}]
    paragraph = lambda style, **run: {"style": style, "runs": [{"t": "x", **run}]}
    docs = [{"styles": styles, "blocks": [paragraph(*p[:1], **p[1])]} for p in (
        (None, {}), (None, {"rstyle": "S"}), (None, {"rstyle": "C"}), ("P", {}), ("P", {"rstyle": "C"}), ("P", {"rstyle": "S"}), ("P", {"hidden": False}), (None, {"hidden": False}))]
    got = {r["doc_id"]: (r["vanish"], r["left_out"]) for r in corpus(spark, *docs).shown_runs().collect()}
    # what the property says and what is shown differ where a paragraph names no style and its run's style decides
    assert got == {0: (True, True), 1: (True, False), 2: (False, True), 3: (True, True), 4: (False, False), 5: (True, True), 6: (False, False), 7: (False, False)}


def test_documents_without_text_have_a_row(spark):
    c = corpus(spark, {"blocks": []}, {"blocks": [{"runs": []}, {"runs": [{"t": ""}]}]}, {"blocks": [{"runs": [{"t": "x"}]}]})
    assert {r["doc_id"]: r["text"] for r in c.text().collect()} == {0: "", 1: "", 2: "x"}


def test_missing_content_says_so(spark):
    c = Corpus(spark.createDataFrame([(1, None), (2, b"nothing")], "doc_id long, content binary"))
    got = {r["doc_id"]: r["message"] for r in c.load_errors.collect()}
    assert "over the limit" in got[1] and "format" in got[2]
    assert c.text().collect() == []


def test_tables_are_shredded_as_they_are_needed(spark):
    c = corpus(spark, {"blocks": [{"runs": [{"t": "x"}]}]})
    c.text()
    assert set(c._stored) == {"inlines", "styles", "loaded"}
    c.shred("blocks")
    assert c.blocks.count() == 1 and "properties" not in c._stored


# ---------------------------------------------------------------- folds
def tabs(spark, *layers):
    kind = "array<struct<position: double, alignment: int, leader: int, clears: boolean>>"
    df = spark.createDataFrame([tuple(layers)], ", ".join(f"t{k} {kind}" for k in range(len(layers))))
    out = F.col("t0")
    for k in range(1, len(layers)):
        out = cascade.tabs_over(out, F.col(f"t{k}"))
    return [(r["position"], r["alignment"]) for r in df.select(cascade.standing_tabs(out).alias("s")).first()["s"] or []]


def test_tab_stops_are_edited(spark):
    at = lambda *p: [(float(x), 0, 0, False) for x in p]
    clear = lambda *p: [(float(x), 6, 0, True) for x in p]
    assert tabs(spark, at(36, 72), clear(36)) == [(72, 0)]
    assert tabs(spark, at(36), [(36.005, 2, 0, False)]) == [(36.005, 2)]
    assert tabs(spark, at(36), clear(36) + at(36)) == [(36, 0)]
    assert tabs(spark, at(36), at(36) + clear(36)) == [(36, 0)]  # what a layer sets is set, whatever it clears
    assert tabs(spark, at(36, 72), None) == [(36, 0), (72, 0)]
    assert tabs(spark, at(36, 72), []) == []
    assert tabs(spark, at(36), clear(72), at(72)) == [(36, 0), (72, 0)]


def test_a_styles_own_tab_list_resets_what_is_below(spark):
    tab = lambda *p: "<w:tabs>" + "".join(f'<w:tab w:val="left" w:pos="{x}"/>' for x in p) + "</w:tabs>"
    styles = [{"id": "A", "name": "A", "ppr": tab(720)}, {"id": "B", "name": "B", "base": "A", "ppr": "<w:tabs/>"}, {"id": "C", "name": "C", "base": "B", "ppr": tab(1440)}]
    c = corpus(spark, {"styles": styles, "blocks": [{"style": "C", "runs": []}, {"style": "A", "runs": [], "ppr": "<w:keepNext/>"}, {"style": "B", "runs": []}]})
    got = {r["path"][0]: [t["position"] for t in r["tab_stops"]] for r in c.paragraph_formats().collect()}
    assert got == {0: [72.0], 1: [36.0], 2: []}


def test_cycles_and_missing_bases_end_a_chain(spark):
    styles = [{"id": "A", "name": "A", "base": "B", "size": 9}, {"id": "B", "name": "B", "base": "A", "b": True}, {"id": "C", "name": "C", "base": "none", "size": 8}]
    c = corpus(spark, {"styles": styles, "blocks": [{"style": s, "runs": [{"t": s}]} for s in ("A", "C", "missing")]})
    got = {r["text"]: (r["size"], r["b"]) for r in c.fonts("size", "b").collect()}
    assert got == {"A": (9.0, True), "C": (8.0, False), "missing": (10.0, False)}


def test_label_places_are_put_in_once(spark):
    numbering = lambda text: {"numbering": f'<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="{text}"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'}
    docs = [{"blocks": [{"num": 1, "runs": []}] * 2, "raw_parts": numbering(t)} for t in ("%1", "%11", "%", "%x", "%0", "")]
    got = {}
    for r in corpus(spark, *docs).labels().orderBy("doc_id", "path").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])
    assert got == {0: ["1", "2"], 1: ["11", "21"], 2: ["%", "%"], 3: ["%x", "%x"], 4: ["0", "0"], 5: ["1.", "2."]}
    assert re.fullmatch("[0-9.]+", got[5][0])
