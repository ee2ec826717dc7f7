"""Declarations, packages with part names of their own, and rules of the formats, on files written by hand."""

import colorsys
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import links
from quire.functions import scalars as S
from quire.operators import edit
from quire.operators.extract import Corpus
from quire.plans import properties, resolve
from quire.sources import package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
O = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"  # noqa: E741
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
    return out.getvalue()


def frame(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "doc_id long, content binary")


#: A package whose parts have other names and prefixes than usual.
ODD = archive({
    "_rels/.rels": f'<Relationships {RELS}><Relationship Id="a" Type="{O}/officeDocument" Target="/content/body.xml"/></Relationships>',
    "content/_rels/body.xml.rels": f'<r:Relationships xmlns:r="{RELS[7:-1]}"><r:Relationship Id="s" Type="{O}/styles" Target="look%20of.xml"/><r:Relationship Id="f" Type="{O}/footnotes" Target="../notes/all.xml"/></r:Relationships>',
    "content/body.xml": f'<x:document xmlns:x="{W[9:-1]}"><x:body><x:p><x:pPr><x:pStyle x:val="H"/></x:pPr><x:r><x:t> one </x:t></x:r><x:r><x:t xml:space="preserve"> two</x:t><x:footnoteReference x:id="4"/><x:t>3</x:t></x:r></x:p></x:body></x:document>',
    "content/look of.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>',
    "notes/all.xml": f'<w:footnotes {W}><w:footnote w:id="4"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
})


def test_relationships_say_what_parts_are(spark):
    c = Corpus(frame(spark, ODD))
    assert c.text().first()["text"] == "one two3"
    assert [(r["heading_level"], r["text"]) for r in c.headings().collect()] == [(2, "one two3")]
    assert [(r["kind"], r["text"]) for r in c.main.orderBy("ord").collect()] == [("Run", "one"), ("Run", " two"), ("NoteReference", "footnote"), ("Run", "3")]
    assert [r["text"] for r in c.stories.collect()] == ["note"] and c.diagnostics().count() == 0
    assert {r["part_name"] for r in resolve.reachable_parts(c.relationships).collect()} == {"content/body.xml", "content/look of.xml", "notes/all.xml"}


def test_names_and_limits(spark, monkeypatch):
    for bad in ("a\\b", "../a", "/a", "a/./b", "%2e%2e/a", ""):
        with pytest.raises(ValueError):
            package.part_key(bad)
    pkg = lambda names: "<p:package xmlns:p='http://schemas.microsoft.com/office/2006/xmlPackage'>" + "".join(f"<p:part p:name='/{n}' p:contentType='x'><p:binaryData>eHh4eA==</p:binaryData></p:part>" for n in names) + "</p:package>"
    assert [n for n, _ in package.flat_decode(pkg(["a", "b"]).encode())][1:] == ["a", "b"]
    for names in (["a", "A"], ["a", "%61"]):
        with pytest.raises(ValueError):
            package.flat_decode(pkg(names).encode())
    wide = ("<?xml version='1.0' encoding='UTF-16'?><!-- " + "x" * 3000 + " -->" + pkg(["a"])).encode("utf-16")
    kinds = frame(spark, wide, pkg(["a"]).encode(), b"PK\x03\x04", b"<html/>", None).select(package.sniff(F.col("content")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["flat_opc", "flat_opc", "docx", None, None]
    monkeypatch.setattr(package, "PART_BYTES", 3)
    with pytest.raises(ValueError):
        package.flat_decode(pkg(["a"]).encode())


def test_mixed_content_survives():
    data = "<p:package xmlns:p='http://schemas.microsoft.com/office/2006/xmlPackage'><p:part p:name='/a.xml' p:contentType='x'><p:xmlData><q>a<b/>c<d>e</d>f</q></p:xmlData></p:part></p:package>"
    assert package.flat_decode(data.encode())[1][1].endswith(b"<q>a<b/>c<d>e</d>f</q>")


def test_large_files_are_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "a.docx").write_bytes(ODD)
    (tmp_path / "b.docx").write_bytes(ODD + b"x" * 5000)
    monkeypatch.setattr(package, "INPUT_BYTES", len(ODD) + 100)
    got = package.read_packages(spark, str(tmp_path)).select("path", F.col("content").isNull().alias("none")).collect()
    assert sorted((r["path"][-6:], r["none"]) for r in got) == [("a.docx", False), ("b.docx", True)]


def test_theme_colors_equal_the_library(spark):
    cases = [(f"{r:02X}{g:02X}{b:02X}", t, s) for r, g, b in ((18, 52, 86), (255, 0, 0), (10, 200, 199), (128, 128, 128), (0, 0, 0), (250, 250, 3)) for t, s in (("66", None), (None, "BF"), ("", "10"), ("33", "99"), (None, None))]

    def want(value, tint, shade):
        if not tint and not shade:
            return value
        h, light, s = colorsys.rgb_to_hls(*(int(value[k : k + 2], 16) / 255 for k in (0, 2, 4)))
        by = int(tint or shade, 16) / 255
        light = light + (1 - light) * (1 - by) if tint else light * by
        return "".join(f"{max(0, min(255, int(c * 255))):02X}" for c in colorsys.hls_to_rgb(h, max(0, min(1, light)), s))

    df = spark.createDataFrame(cases, "v string, t string, s string").select("v", "t", "s", S.theme_color(F.col("v"), F.col("t"), F.col("s")).alias("c"))
    for r in df.collect():
        a, b = r["c"], want(r["v"], r["t"], r["s"])
        assert all(abs(int(a[k : k + 2], 16) - int(b[k : k + 2], 16)) <= 1 for k in (0, 2, 4)), (r, b)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(S.letters(F.lit(n))) for n in (0, 1, 26, 27, 703, 475255)] == ["", "a", "z", "aa", "aaa", "aaaaa"]
    assert [one(S.note_id(F.lit(v))) for v in ("7", " -3 ", "1.9", "2e3", "x", "9999999999999999999999", "4294967295", "1e999")] == [7, -3, 1, 2000, 0, -1, -1, 0]
    assert one(S.color_channels(F.lit("Color [A=255, R=1, G=2, B=3]"))).asDict() == {"r": 1, "g": 2, "b": 3} and one(S.color_channels(F.lit("Color [Empty]"))) is None
    assert one(S.tab_interval(F.lit(36.02))) == 36.0 and one(S.tab_interval(F.lit(float("inf")))) == -2147483648 / 20
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC0001108000A0014030122")
    assert one(S.jpeg_size(F.lit(jpeg))).asDict() == {"width": 20, "height": 10}
    assert [one(S.canonical_style_name(F.lit(n))) for n in ("toa heading", "table of figures", "MyOwn", "macro", "toc 1")] == ["TOA Heading", "Table of Figures", "MyOwn", "Macro Text", "TOC 1"]
    assert one(links.segments(F.lit("no links")))[0]["text"] == "no links"


def test_outline_of_many_levels(spark):
    levels = [1, 3, 2, 3, 9, 4, 1, 2, 2, 5, 3, 1]
    open_, want = [], []
    for x in levels:
        open_ = [y for y in open_ if y < x] + [x]
        want.append(len(open_))
    df = spark.createDataFrame([(0, [k], x) for k, x in enumerate(levels)], "doc_id long, path array<int>, heading_level int")
    assert [r["depth"] for r in resolve.outline(df).orderBy("path").collect()] == want


def test_a_million_styles(spark):
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    chains = ids.select("doc_id", F.concat(F.lit("S"), "k").alias("style_id"), F.transform(F.sequence("k", F.lit(0), F.lit(-1)), lambda x: F.concat(F.lit("S"), x)).alias("chain"))
    got = resolve.style_layers(chains).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).first()
    assert (got["n"], got["d"]) == (200_000 * 21, 5)


def test_plans_read_the_packages_once(spark):
    c = Corpus(frame(spark, ODD))
    for df in (c.fonts(), c.headings(), c.labels(), c.export()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 1 and "recursive" not in plan.lower()


def test_bad_measures_are_errors(spark):
    rows = spark.createDataFrame([("paragraph", {"ind@left": "1x"})], "owner string, props map<string,string>").selectExpr("1L doc_id", "'p' part_name", "array(0) path", "0 ord", "'' ident", "*")
    with pytest.raises(Exception, match="not a whole number"):
        properties.paragraph_formats(rows).select("left_indent").collect()


def test_signed_documents_stay(spark):
    with zipfile.ZipFile(io.BytesIO(ODD)) as z:
        signed = archive({**{n: z.read(n) for n in z.namelist()}, "_xmlsignatures/s.xml": "<s/>"})
    out = edit.replace_text(Corpus(frame(spark, ODD, signed)).parts, {"note": "NOTE"}).collect()
    assert {r["doc_id"] for r in out if r["load_error"]} == {1} and {r["doc_id"] for r in out} == {0, 1}
