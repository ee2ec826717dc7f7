"""Queries on formats through all layers, and on text as they make it: hidden runs, capitals, labels, links, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import links
from .plans import conditions, properties
from .queries import _LINE, _N, _WORD, _corpus, _lines, _parts_of, _table, _texts, query

_X = [{"t": "x"}]


@query(f"SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text FROM ({_LINE}) GROUP BY doc_id")
def style_hidden_text(spark, d):
    """Each paragraph has one run that shows and one that some style hides."""
    styles = [
        {"id": "Normal", "name": "Normal", "default": True}, {"id": "Base", "name": "Base", "kind": "character", "hidden": True}, {"id": "Hide", "name": "Hide", "kind": "character", "base": "Base"},
        {"id": "Gone", "name": "Gone", "hidden": True}]

    def paragraph(k, x):
        out = {"t": "left out", "rstyle": "Hide"}
        return [
            {"runs": [out, {"t": x}]},
            # both styles hide: their difference shows
            {"style": "Gone", "runs": [{"t": "left out"}, {"t": x, "rstyle": "Hide"}]},
            {"runs": [out, {"t": x, "rstyle": "Hide", "hidden": False}]},
            {"style": "Gone", "runs": [{"t": "left out"}, {"t": x, "hidden": False}]}][k % 4]

    return _corpus(_texts(spark, d), lambda row: {"styles": styles, "blocks": [paragraph(k, x) for k, x in enumerate(_lines(row))]}).text()


@query(f"SELECT doc_id, CASE n % 4 WHEN 0 THEN 'MIX' WHEN 1 THEN 'MIX' WHEN 2 THEN 'Mix' ELSE 'MIX' END || n || CASE WHEN n % 4 = 2 THEN 'ed' ELSE 'ED' END AS text FROM ({_N})")
def small_caps_text(spark, d):
    def describe(n):
        styles = [{"id": "Normal", "name": "Normal", "default": True}, {"id": "Small", "name": "Small", "rpr": "<w:smallCaps/>"}, {"id": "Caps", "name": "Caps", "kind": "character", "caps": True}]
        run = [{"t": f"Mix{n}ed"}, {"t": f"Mix{n}ed", "rstyle": "Caps"}, {"t": f"Mix{n}ed", "rpr": '<w:smallCaps w:val="off"/>'}, {"t": f"Mix{n}ed", "rpr": "<w:smallCaps/>"}][n % 4]
        return {"styles": styles, "blocks": [{"style": None if n % 4 in (1, 3) else "Small", "runs": [run]}]}

    return _parts_of(spark, d, describe).text()


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE 'x' END AS text FROM documents")
def empty_documents(spark, d):
    return _corpus(_texts(spark, d), lambda row: {"blocks": [] if row["lang"] == "de" else [{"runs": _X}]}).text()


@query(f"""SELECT doc_id, k::INT AS place, ['.1', '.2', 'i.', 'i.1', '0)', 'x', ' of level 2', 'A0'][k + 1] AS label FROM ({_N}), (SELECT unnest(range(8)) AS k) WHERE k < 5 + n % 4""")
def label_edge_cases(spark, d):
    """A level without format, ancestors that have not counted, a place for level 0, a format without a kind, an unknown kind."""
    def level(k, fmt, text):
        return f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/>{fmt and f"<w:numFmt w:val=\"{fmt}\"/>"}<w:lvlText w:val="{text}"/></w:lvl>'

    def numbering():
        shapes = [[level(0, "lowerRoman", ""), level(1, "decimal", "%1.%2")], [level(0, "decimal", "%0)")], [level(0, "", "x")], [level(0, "upperLetter", "%1"), level(1, "lowerLetter", "%1 of level 2")], [level(0, "upperLetter", "%1%2"), level(1, "odd", "")]]
        body = "".join(f'<w:abstractNum w:abstractNumId="{k}">{"".join(x)}</w:abstractNum>' for k, x in enumerate(shapes))
        return f'<w:numbering {_WORD}>{body}{"".join(f"<w:num w:numId=\"{k + 1}\"><w:abstractNumId w:val=\"{k}\"/></w:num>" for k in range(len(shapes)))}</w:numbering>'

    def describe(n):
        items = [(1, 1), (1, 1), (1, 0), (1, 1), (2, 0), (3, 0), (4, 1), (5, 0)][: 5 + n % 4]
        return {"blocks": [{"num": i, "level": k, "runs": _X} for i, k in items], "raw_parts": {"numbering": numbering()}}

    labels = _parts_of(spark, d, describe).labels()
    return labels.select("doc_id", F.element_at("path", 1).alias("place"), "label")


@query(r"SELECT page_id AS doc_id, 'a [b] \ <' || page_id || '>' AS text, coalesce(url, '') || CASE page_id % 4 WHEN 0 THEN '?x=1&y=(2)' WHEN 1 THEN '?q=a b(c)' WHEN 2 THEN '\path)' ELSE '' END AS url FROM pages")
def link_roundtrip(spark, d):
    """A link written as text and found again is the same, whatever its label and target hold."""
    p, k = _table(spark, d, "pages"), F.col("page_id") % 4
    more = F.when(k == 0, "?x=1&y=(2)").when(k == 1, "?q=a b(c)").when(k == 2, "\\path)").otherwise("")
    text = links.markup(F.concat(F.lit("a [b] \\ <"), "page_id", F.lit(">")), F.concat(F.coalesce("url", F.lit("")), more))
    return p.select(F.col("page_id").alias("doc_id"), F.inline(links.segments(text)))


# ------------------------------------------------------------------------------------------------ fonts of runs
@query(f"""SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'Own' WHEN n % 3 = 0 THEN 'Char' ELSE 'Base' END AS name, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 3 = 0 THEN 3 ELSE 1 END::INT AS underline,
'Color [A=255, R=0, G=' || CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END || ', B=0]' AS color, 'Color [A=255, R=255, G=255, B=0]' AS highlight, n % 3 <> 0 AS strike, 'de-de' AS locale, CASE WHEN n % 4 = 0 THEN n / 2.0 ELSE 8 END::DOUBLE AS size FROM ({_N})""")
def run_font_cascade(spark, d):
    """Name, underline, colour, highlight, a toggle, language and size, each from another layer."""
    def describe(n):
        styles = [
            {"id": "Normal", "name": "Normal", "default": True},
            {"id": "Base", "name": "Base", "base": "Normal", "rpr": '<w:rFonts w:ascii="Base"/><w:color w:val="000100"/><w:highlight w:val="yellow"/><w:strike/><w:sz w:val="16"/><w:u w:val="single"/>'},
            {"id": "Para", "name": "Para", "base": "Base", "rpr": '<w:highlight w:val="none"/>' + ('<w:color w:val="000200"/>' if n % 7 == 0 else "")},
            {"id": "Char", "name": "Char", "kind": "character", "rpr": '<w:rFonts w:hAnsi="Char"/><w:u w:val="double"/><w:strike/>'}]
        own = ('<w:rFonts w:ascii="Own"/>' if n % 2 == 0 else "") + ('<w:u w:val="none"/>' if n % 5 == 0 else "") + (f'<w:sz w:val="{n}"/>' if n % 4 == 0 else "")
        return {"styles": styles, "defaults": {"rpr": '<w:lang w:val="de-DE"/>'}, "blocks": [{"style": "Para", "runs": [{"t": "x", "rstyle": "Char" if n % 3 == 0 else None, "rpr": own}]}]}

    return _parts_of(spark, d, describe).fonts().select("doc_id", "name", "underline", "color", "highlight", "strike", "locale", "size")


@query(f"""SELECT doc_id, CASE n % 3 WHEN 0 THEN 9.0 WHEN 1 THEN 12.0 ELSE CASE WHEN n = 10 THEN 12.0 ELSE n END END::DOUBLE AS size,
CASE n % 3 WHEN 0 THEN 9.0 WHEN 1 THEN 12.0 ELSE n END::DOUBLE AS paint_size FROM (SELECT doc_id, greatest(n, 1) AS n FROM ({_N}))""")
def table_run_sizes(spark, d):
    """Normal at its built-in size gives way to the table's style, unless the settings say otherwise."""
    def describe(n):
        n = max(n, 1)
        styles = [
            {"id": "Normal", "name": "Normal", "default": True, "size": 12}, {"id": "Other", "name": "Other", "size": 9},
            {"id": "T", "name": "T", "kind": "table", "size": n}]
        switch = '<w:compatSetting w:name="overrideTableStyleFontSizeAndJustification" w:uri="http://schemas.microsoft.com/office/word" w:val="1"/>' if n % 3 == 1 else ""
        cell = {"blocks": [{"style": "Other" if n % 3 == 0 else None, "runs": _X}]}
        return {"styles": styles, "blocks": [{"table": [[cell]], "tblpr": '<w:tblStyle w:val="T"/>'}], "raw_parts": {"settings": f"<w:settings {_WORD}><w:zoom/><w:compat>{switch}</w:compat></w:settings>"}}

    return _parts_of(spark, d, describe).fonts().select("doc_id", "size", "paint_size")


# ------------------------------------------------------------------------------------------------ paragraphs
@query(f"""SELECT doc_id, CASE n % 4 WHEN 0 THEN [72.0, 144.0] WHEN 1 THEN [] WHEN 2 THEN [36.0, 72.0, 144.0] ELSE [36.0, 144.0, 180.0] END::DOUBLE[] AS positions, CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END::INT AS second_leader,
CASE WHEN n % 5 = 0 THEN '0000FF' WHEN n % 3 = 0 THEN 'FF0000' ELSE '00FF00' END AS background, n % 2 <> 0 AS top_border, n % 2 = 0 AS left_border FROM ({_N})""")
def layered_paragraphs(spark, d):
    """Tab stops cleared, moved, added or all removed; blank shading passed over; borders taken whole."""
    def describe(n):
        tabs = lambda *t: "<w:tabs>" + "".join(f'<w:tab w:val="{v}" w:pos="{p}"{more}/>' for v, p, more in t) + "</w:tabs>"
        shade = lambda fill: f'<w:shd w:val="clear" w:color="auto" w:fill="{fill}"/>'
        styles = [
            {"id": "Base", "name": "Base", "ppr": '<w:pBdr><w:top w:val="single" w:sz="4"/></w:pBdr>' + shade("00FF00") + tabs(("left", 720, ""), ("left", 1440, ""), ("left", 2880, ""))},
            {"id": "Para", "name": "Para", "base": "Base", "ppr": shade("FF0000" if n % 3 == 0 else "auto") + (tabs(("clear", 720, "")) if n % 4 == 0 else "")}]
        own = {0: "", 1: "<w:tabs/>", 2: tabs(("left", 1440, ' w:leader="dot"')), 3: tabs(("clear", 1440, ""), ("left", 3600, ""))}[n % 4]
        own = ('<w:pBdr><w:left w:val="double" w:sz="4"/></w:pBdr>' if n % 2 == 0 else "") + shade("0000FF" if n % 5 == 0 else "") + own
        return {"styles": styles, "blocks": [{"style": "Para", "runs": _X, "ppr": own}]}

    f = _parts_of(spark, d, describe).paragraph_formats()
    return f.select("doc_id", F.col("tab_stops.position").alias("positions"), F.coalesce(F.get(F.col("tab_stops.leader"), F.lit(1)), F.lit(0)).alias("second_leader"), F.col("shading.background").alias("background"),
                    F.col("borders.top").isNotNull().alias("top_border"), F.col("borders.left").isNotNull().alias("left_border"))


# ------------------------------------------------------------------------------------------------ cells
def _region(kind: str, rpr: str = "", ppr: str = "") -> str:
    return f'<w:tblStylePr w:type="{kind}">{ppr and f"<w:pPr>{ppr}</w:pPr>"}{rpr and f"<w:rPr>{rpr}</w:rPr>"}</w:tblStylePr>'


def _regional(n: int) -> dict:
    font = lambda name: f'<w:rFonts w:ascii="{name}"/>'
    styles = [
        {"id": "Base", "name": "Base", "kind": "table", "more": _region("firstRow", f'<w:sz w:val="{n + 20}"/>') + _region("firstRow", '<w:sz w:val="2"/>') + _region("band1Horz", ppr='<w:jc w:val="right"/>'), "ppr": f'<w:spacing w:before="{n * 20}"/>'},
        {"id": "T", "name": "T", "kind": "table", "base": "Base", "ppr": '<w:jc w:val="center"/>', "rpr": font("Whole") + '<w:sz w:val="10"/>',
         "more": '<w:tblPr><w:tblStyleRowBandSize w:val="1"/><w:tblStyleColBandSize w:val="1"/></w:tblPr>' + _region("firstCol", font("Col")) + _region("firstRow", "<w:b/>", "<w:keepNext/>")
         + _region("band1Vert", font("V1")) + _region("band2Vert", font("V2")) + _region("band2Horz", ppr='<w:jc w:val="both"/>')}]
    row = lambda *spans: [{"t": "x", "span": s} for s in spans]
    look = {0: "07A0", 1: "0220", 2: "0420"}[n % 3]  # first row and edge columns; first row and column bands; first row and row bands
    return {"styles": styles, "blocks": [{"table": [row(2, 1, 1), row(1, 1, 1, 1), row(1, 1, 1, 1)], "tblpr": f'<w:tblStyle w:val="T"/><w:tblLook w:val="{look}"/>'}]}


_GRID = f"SELECT doc_id, n, r, k, CASE WHEN r = 0 THEN [0, 2, 3][k + 1] ELSE k END AS c FROM ({_N}), (SELECT unnest(range(3)) AS r), (SELECT unnest(range(4)) AS k) WHERE r > 0 OR k < 3"


@query(f"SELECT doc_id, r::INT AS \"row\", k::INT AS cell, CASE n % 3 WHEN 0 THEN CASE WHEN k = 0 THEN 'Col' ELSE 'Whole' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'V1' ELSE 'V2' END ELSE 'Whole' END AS name, 5.0::DOUBLE AS size, r = 0 AS bold FROM ({_GRID})")
def cell_fonts(spark, d):
    """By the property's rule the derived style's own size comes after its base's first row; cells are counted as they stand."""
    return _parts_of(spark, d, _regional).cell_fonts().select("doc_id", "row", "cell", "name", "size", F.coalesce("b", F.lit(False)).alias("bold"))


@query(f"SELECT doc_id, r::INT AS \"row\", k::INT AS cell, CASE n % 3 WHEN 0 THEN CASE WHEN c = 0 THEN 'Col' ELSE 'Whole' END WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 'V1' ELSE 'V2' END ELSE 'Whole' END AS name, CASE WHEN r = 0 THEN (n + 20) / 2.0 ELSE 5 END::DOUBLE AS size FROM ({_GRID})")
def painted_cell_fonts(spark, d):
    """Painted, whole tables come first and regions after, and columns are those of the grid."""
    return _parts_of(spark, d, _regional).cell_fonts("grid").select("doc_id", "row", "cell", "name", "size")


@query(f"""SELECT doc_id, r::INT AS "row", k::INT AS cell, n::DOUBLE AS space_before, r = 0 AS keep_next, CASE WHEN n % 3 = 2 AND r = 2 THEN 3 ELSE 1 END::INT AS alignment,
CASE WHEN n % 3 = 2 AND r = 2 THEN 3 WHEN n % 3 = 2 AND r = 1 THEN 2 ELSE 1 END::INT AS painted FROM ({_GRID})""")
def cell_paragraph_formats(spark, d):
    c = _parts_of(spark, d, _regional)
    painted = c.cell_paragraph_formats("grid").select("doc_id", "table_path", "row", "cell", F.col("alignment").alias("painted"))
    own = c.cell_paragraph_formats().select("doc_id", "table_path", "row", "cell", "space_before", F.coalesce("keepNext", F.lit(False)).alias("keep_next"), "alignment")
    return own.join(painted, ["doc_id", "table_path", "row", "cell"]).drop("table_path")


# ------------------------------------------------------------------------------------------------ shapes
_DRAWN = " ".join(f'xmlns:{k}="{v}"' for k, v in {
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "wps": "http://schemas.microsoft.com/office/word/2010/wordprocessingShape", "wpg": "http://schemas.microsoft.com/office/word/2010/wordprocessingGroup"}.items())


@query(f"""SELECT doc_id, shape, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, fill, text FROM (SELECT doc_id, k::INT AS shape, CASE WHEN n % 3 = 2 THEN 10.0 + 100 ELSE 10.0 END + CASE WHEN n % 3 = 0 THEN 0 WHEN k = 0 THEN (n - 2) * 2.0 ELSE 7.0 + 3 * 2 * 3 END AS x,
20.0 + CASE WHEN n % 2 = 0 THEN 50 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0 WHEN k = 0 THEN 4 * 0.5 ELSE 9.0 + 4 * 0.5 * 0.25 END AS y,
CASE WHEN n % 3 = 0 THEN 40.0 WHEN k = 0 THEN 5 * 2.0 ELSE 5 * 6.0 END AS width, CASE WHEN n % 3 = 0 THEN NULL ELSE 'FF0000' END AS fill, CASE WHEN n % 3 = 0 THEN 'box' ELSE 's' || k END AS text
FROM ({_N}), (SELECT unnest(range(2)) AS k) WHERE n % 3 > 0 OR k = 0)""")
def shape_places(spark, d):
    """A text box of its own, and shapes in a group and in a group inside it, with their scales; anchors from the page and margins."""
    emu = lambda x: round(x * 12700)
    frame = lambda off, ext, child, units: f'<wpg:grpSpPr><a:xfrm><a:off x="{emu(off[0])}" y="{emu(off[1])}"/><a:ext cx="{ext[0]}" cy="{ext[1]}"/><a:chOff x="{emu(child)}" y="0"/><a:chExt cx="{units[0]}" cy="{units[1]}"/></a:xfrm></wpg:grpSpPr>'

    def shape(text, x, y, fill=True):
        color = '<a:solidFill><a:srgbClr val="FF0000"/></a:solidFill>' if fill else ""
        return f'<wps:wsp><wps:spPr><a:xfrm><a:off x="{emu(x)}" y="{emu(y)}"/><a:ext cx="{emu(5)}" cy="{emu(5)}"/></a:xfrm>{color}</wps:spPr><wps:txbx><w:txbxContent><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:txbxContent></wps:txbx></wps:wsp>'

    def describe(n):
        body = shape("box", 0, 0, False) if n % 3 == 0 else f'<wpg:wgp>{frame((0, 0), (200, 50), 2, (100, 100))}{shape("s0", n, 4)}<wpg:grpSp>{frame((7, 9), (300, 25), 0, (100, 100))}{shape("s1", 3, 4)}</wpg:grpSp></wpg:wgp>'
        place = f'<wp:positionH relativeFrom="{"margin" if n % 3 == 2 else "page"}"><wp:posOffset>{emu(10)}</wp:posOffset></wp:positionH><wp:positionV relativeFrom="{"paragraph" if n % 2 == 0 else "page"}"><wp:posOffset>{emu(20)}</wp:posOffset></wp:positionV>'
        drawing = f'<w:r><w:drawing><wp:anchor {_DRAWN}>{place}<wp:extent cx="{emu(40)}" cy="{emu(30)}"/><a:graphic><a:graphicData>{body}</a:graphicData></a:graphic></wp:anchor></w:drawing></w:r>'
        return {"blocks": [{"runs": [{"t": "x"}, {"raw": drawing}]}], "sect": {"raw": '<w:pgMar w:top="1000" w:left="2000"/>'}}

    c = _parts_of(spark, d, describe)
    at = conditions.page_places(c.placed_shapes, properties.page_setups(c.properties))
    return at.select("doc_id", "shape", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "width", "fill", "text")
