import io
import zipfile

import pytest

from quire.operators import edit, pdf
from quire.operators.extract import Corpus
from quire.plans import resolve
from quire.sources import package, xml
from quire.sources.builder import build, make_packages


def corpus(spark, docs):
    rows = spark.createDataFrame([(k, package.zip_parts(build(d))) for k, d in enumerate(docs)], "doc_id long, content binary")
    return Corpus(rows)


def test_text_round_trip(spark):
    text = "a  b\nümlaut <&> \"q\"\n  indented"
    c = corpus(spark, [{"blocks": [{"runs": [{"t": x}]} for x in text.split("\n")]}])
    assert [r["text"] for r in c.text().collect()] == [text]


def test_hostile_archives():
    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return out.getvalue()

    for bad in (archive("../x"), archive("/x"), archive("a", "a"), b"PK\x03\x04 broken"):
        with pytest.raises(ValueError):
            package.unzip(bad)
    with pytest.raises(ValueError):
        xml.parse(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')


def test_load_errors_are_rows(spark):
    df = spark.createDataFrame([(1, b"{\\rtf1"), (2, None), (3, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")], "doc_id long, content binary")
    got = {r["doc_id"]: r["load_error"] for r in package.parts(df).collect()}
    assert set(got) == {1, 2, 3} and all(got.values())


def test_flat_form_round_trip():
    parts = build({"blocks": [{"runs": [{"t": "x & y"}]}], "media": {"a.png": b"\x89PNG"}})
    back = dict(package.flat_decode(package.flat_encode(parts)))
    assert back["word/media/a.png"] == b"\x89PNG"
    assert "x &amp; y" in back["word/document.xml"].decode()


def test_flat_parts_keep_their_bytes():
    # equal parts stay equal bytes, so that what was made of them once is used again
    parts = [(n, b) for n, b in build({"blocks": [{"runs": [{"t": "x & y"}]}]}) if n != "[Content_Types].xml"]
    assert package.flat_decode(package.flat_encode(parts))[1:] == parts
    one = lambda payload: f"<k:package xmlns:k='{package.xml.PKG[1:-1]}' xmlns:a='urn:a' xmlns='urn:d'><k:part k:name='/x.xml' k:contentType='x'><k:xmlData>{payload}</k:xmlData></k:part></k:package>".encode()
    for payload, tag in (("<a:q><r a:s='>'/>\u00e9</a:q>", "{urn:a}q"), ("<q/>", "{urn:d}q"), ("<q xmlns=''/>", "q"), ("<a:q xmlns:a='urn:b'><a:q>1</a:q></a:q>", "{urn:b}q")):
        for data in (one(payload), b"\xef\xbb\xbf" + one(payload), ("<?xml version='1.0' encoding='UTF-16'?>" + one(payload).decode()).encode("utf-16")):
            want = package.xml.parse(one(payload)).children[0].children[0].children[0]
            got = package.xml.parse(package.flat_decode(data)[1][1])
            flat = lambda e: [(x.tag, x.attrs, x.text, len(x.children)) for x in e.walk()]
            assert got.tag == tag and flat(got) == flat(want)
    for bad in (one("<q/><q/>"), one("<z:q/>"), one("<q>"), b"<!DOCTYPE x>" + one("<q/>")):
        with pytest.raises(ValueError):
            package.flat_decode(bad)


def test_recoded_packages_stay_where_they_are(spark):
    made = [(k, package.zip_parts(build({"blocks": [{"runs": [{"t": f"t{k}"}]}]}))) for k in range(5)]
    df = spark.createDataFrame([*made, (7, b"nothing"), (8, None)], "doc_id long, content binary")
    flat = package.recoded(df, "flat_opc")
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in Corpus(flat).text().collect()} == {k: f"t{k}" for k in range(5)}
    assert {r["doc_id"] for r in Corpus(flat).load_errors.collect()} == {7, 8}
    assert {r["doc_id"]: bytes(r["content"]) for r in package.recoded(package.recoded(df.filter("doc_id < 5"), "flat_opc")).collect()}.keys() == set(range(5))


def test_style_cycle_and_missing_base_end(spark):
    styles = [{"id": "A", "name": "A", "base": "B"}, {"id": "B", "name": "B", "base": "C"}, {"id": "C", "name": "C", "base": "A"}, {"id": "D", "name": "D", "base": "gone"}]
    c = corpus(spark, [{"blocks": [], "styles": styles}])
    got = {(r["style_id"], r["depth"], r["layer_id"]) for r in resolve.style_layers(c.styles).collect()}
    assert ("A", 2, "C") in got and len([g for g in got if g[0] == "A"]) == 3
    assert [g for g in got if g[0] == "D"] == [("D", 0, "D")]


def test_field_states_nest(spark):
    runs = [{"field": " OUTER ", "inner": [{"field": " INNER ", "t": "SECRET"}], "t": "VISIBLE"}]
    c = corpus(spark, [{"blocks": [{"runs": runs}]}])
    assert [r["text"] for r in c.text().collect()] == ["VISIBLE"]


def labels_by_fold(items, levels):
    counters, out = {}, []
    for list_id, level in items:
        own = levels[list_id]
        level = min(level, len(own) - 1)
        style, fmt, start = own[level]
        if style in (23, 255):
            out.append(fmt)
            continue
        c = counters.setdefault(list_id, {})
        c[level] = c[level] + 1 if level in c else max(start, 1)
        for deeper in [k for k in c if k > level]:
            del c[deeper]
        out.append("".join(str(c.get(int(x[0]) - 1, 0)) + x[1:] if x else "" for x in fmt.split("%")))
    return out


def test_list_labels_equal_a_fold(spark):
    import random

    rng = random.Random(3)
    levels = {1: [(0, "%1.", 1), (0, "%1.%2.", 3), (0, "%1.%2.%3", 0)], 2: [(0, "%1)", 5), (23, "*", 1)]}
    items = [(rng.choice([1, 1, 2]), rng.randrange(4)) for _ in range(200)]
    want = labels_by_fold(items, levels)
    df = spark.createDataFrame([(0, [k], lid, lvl) for k, (lid, lvl) in enumerate(items)], "doc_id long, path array<int>, list_id int, level int")
    lv = spark.createDataFrame([(0, lid, k, *x) for lid, own in levels.items() for k, x in enumerate(own)], "doc_id long, list_id int, level int, number_style int, number_format string, start_at int")
    got = {r["path"][0]: r["label"] for r in resolve.list_labels(df, lv).collect()}
    assert [got[k] for k in range(len(items))] == want


def test_replacement_keeps_other_bytes(spark):
    data = b'<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:r><w:t>one two</w:t></w:r><w:x a="one"/></w:p>'
    new, found = edit.replace_in_part(data, {"one": "1", "one two": "12"})
    assert new == data.replace(b">one two<", b">12<") and found == {"one": 0, "one two": 1}


def test_cells_nest_and_diagnostics(spark):
    doc = {"blocks": [{"runs": [{"t": "a", "wrap": "ins"}]}, {"table": [[{"blocks": [{"runs": [{"t": "b"}]}, {"table": [[{"t": "c"}]]}, {"runs": [{"t": "d"}]}]}]]}, {"runs": [{"note": 5}]}]}
    c = corpus(spark, [doc])
    assert c.text().first()["text"] == "a\nb\nc\nd"
    assert {(r["code"], r["message"]) for r in c.diagnostics().collect()} == {("unsupported_construct", "ins x 1"), ("anchor_fault", "missing_story")}
    assert c.cells.count() == 2


def test_pdf_pages_and_outline():
    data, pages = pdf.render([("Title", 1), *[("word " * 40, None)] * 40])
    assert data.startswith(b"%PDF-1.7") and data.endswith(b"%%EOF\n") and pages == data.count(b"/Type/Page/") > 1
    assert b"/Title (Title)" in data
    assert pdf.wrap("a" * 200, 80) == ["a" * 80, "a" * 80, "a" * 40]


def test_written_packages_come_back(spark, tmp_path):
    made = make_packages(spark.createDataFrame([(7, "x")], "doc_id long, text string"), lambda r: {"blocks": [{"runs": [{"t": r["text"]}]}]})
    edit.write_packages(made, f"file://{tmp_path}/out").collect()
    back = package.read_packages(spark, str(tmp_path / "out"))
    assert Corpus(back.select("doc_id", "content")).text().first()["text"] == "x"


def test_empty_corpus(spark):
    c = Corpus(spark.createDataFrame([], "doc_id long, content binary"))
    assert c.text().count() == c.headings().count() == c.diagnostics().count() == c.export().count() == 0
