"""Packages made from rows: the blocks of a document, described by small JSON-like values, written as WordprocessingML.

A block is a dict: {"style", "runs", "num", "level", "sect", "marks"} for a paragraph, {"table": rows of cells} for a
table. A run is a dict {"t": text} with any of b, i, caps, hidden, size, link, rstyle, field, note, comment, bm.
"""

from __future__ import annotations

import marshal
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .package import MAIN_TYPE, OFFICE, WML, zip_parts
from .xml import SMALL, allowed, escape

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
DEFAULT_STYLES: list[dict[str, Any]] = [
    {"id": "Normal", "name": "Normal", "default": True},
    *({"id": f"Heading{k}", "name": f"heading {k}", "base": "Normal", "outline": k - 1, "b": True} for k in range(1, 10)),
    {"id": "ListParagraph", "name": "List Paragraph", "base": "Normal"},
    {"id": "DefaultParagraphFont", "name": "Default Paragraph Font", "kind": "character", "default": True},
]


def _on(tag: str, value: bool | None) -> str:
    return "" if value is None else f"<w:{tag}/>" if value else f'<w:{tag} w:val="0"/>'


def run_properties(r: dict[str, Any]) -> str:
    out = f'<w:rStyle w:val="{escape(r["rstyle"])}"/>' if r.get("rstyle") else ""
    out += _on("b", r.get("b")) + _on("i", r.get("i")) + _on("caps", r.get("caps")) + _on("vanish", r.get("hidden"))
    if r.get("size") is not None:
        out += f'<w:sz w:val="{round(r["size"] * 2)}"/>'
    out += r.get("rpr", "")
    return f"<w:rPr>{out}</w:rPr>" if out else ""


class Writer:
    """Collects what the body of one document refers to while its blocks are written."""

    def __init__(self, styles: list[dict[str, Any]] | None = None):
        self.styles = DEFAULT_STYLES if styles is None else styles
        self.links: dict[str, str] = {}
        self.rels: list[tuple[str, str, str, bool]] = []
        self.bookmarks = 0

    def rel(self, kind: str, target: str, external: bool = False) -> str:
        rid = f"rId{len(self.rels) + 1}"
        self.rels.append((rid, kind, target, external))
        return rid

    def link(self, url: str) -> str:
        if url not in self.links:
            self.links[url] = self.rel("hyperlink", url, True)
        return self.links[url]

    def run(self, r: dict[str, Any]) -> str:
        if "field" in r:  # begin, the instruction, separator, result, end
            inner = "".join(map(self.run, r.get("inner", [])))
            result = self.run({k: v for k, v in r.items() if k not in ("field", "inner")}) if r.get("t") else ""
            mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
            return f'{mark("begin")}<w:r><w:instrText xml:space="preserve">{escape(r["field"])}</w:instrText></w:r>{inner}{mark("separate")}{result}{mark("end")}'
        if r.get("t") == "\0PAGE\0":  # the number of a page is a field of its own
            return self.run({"field": " PAGE ", "t": "1"})
        if "bm" in r:
            self.bookmarks += 1
            inner = self.run({k: v for k, v in r.items() if k != "bm"})
            return f'<w:bookmarkStart w:id="{self.bookmarks}" w:name="{escape(r["bm"])}"/>{inner}<w:bookmarkEnd w:id="{self.bookmarks}"/>'
        if "note" in r:
            return f'<w:r><w:footnoteReference w:id="{r["note"]}"/></w:r>'
        if "comment" in r:
            return f'<w:r><w:commentReference w:id="{r["comment"]}"/></w:r>'
        if "raw" in r:
            return r["raw"]
        if "wrap" in r:
            return f'<w:{r["wrap"]}>{self.run({k: v for k, v in r.items() if k != "wrap"})}</w:{r["wrap"]}>'
        # a carriage return in a text element is read as a blank: it is an element of its own
        shown = "<w:cr/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in allowed(r.get("t") or "").split("\r"))
        text = f"<w:r>{run_properties(r)}{shown}</w:r>"
        if r.get("link"):
            url, _, anchor = r["link"].partition("#")
            extra = f' w:anchor="{escape(anchor)}"' if anchor else ""
            return f'<w:hyperlink r:id="{self.link(url)}"{extra}>{text}</w:hyperlink>'
        return text

    def paragraph(self, p: dict[str, Any]) -> str:
        props = f'<w:pStyle w:val="{escape(p["style"])}"/>' if p.get("style") else ""
        if p.get("num") is not None:
            props += f'<w:numPr><w:ilvl w:val="{p.get("level", 0)}"/><w:numId w:val="{p["num"]}"/></w:numPr>'
        props += p.get("ppr", "")
        if p.get("outline") is not None:
            props += f'<w:outlineLvl w:val="{p["outline"]}"/>'
        if "sect" in p:
            props += self.section(p["sect"])
        ident = f' w14:paraId="{p["para_id"]}"' if p.get("para_id") else ""
        return f"<w:p{ident}>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(map(self.run, p.get('runs', [])))}</w:p>"

    def section(self, s: dict[str, Any]) -> str:
        refs = "".join(f'<w:{kind}Reference w:type="{variant}" r:id="{rid}"/>' for kind, variant, rid in s.get("refs", []))
        return f'<w:sectPr>{refs}<w:pgSz w:w="{s.get("w", 12240)}" w:h="{s.get("h", 15840)}"/>{s.get("raw", "")}</w:sectPr>'

    def table(self, rows: list[list[dict[str, Any]]], tblpr: str = "", trpr: list[str] | None = None, grid: list[int] | None = None) -> str:
        out = []
        for n, row in enumerate(rows):
            cells = []
            for c in row:
                props = f'<w:gridSpan w:val="{c["span"]}"/>' if c.get("span", 1) != 1 else ""
                props += f'<w:hMerge w:val="{c["hmerge"]}"/>' if c.get("hmerge") else ""
                props += ("<w:vMerge/>" if c["vmerge"] == "continue" else '<w:vMerge w:val="restart"/>') if c.get("vmerge") else ""
                props += c.get("tcpr", "")
                blocks = c.get("blocks") or [{"runs": [{"t": c.get("t", "")}]}]
                cells.append(f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{''.join(map(self.block, blocks))}</w:tc>")
            own = f"<w:trPr>{trpr[n]}</w:trPr>" if trpr and trpr[n] else ""
            out.append(f"<w:tr>{own}{''.join(cells)}</w:tr>")
        columns = f"<w:tblGrid>{''.join(f'<w:gridCol w:w=\"{g}\"/>' for g in grid)}</w:tblGrid>" if grid else ""
        return f"<w:tbl><w:tblPr>{tblpr}</w:tblPr>{columns}{''.join(out)}</w:tbl>"

    def block(self, b: dict[str, Any]) -> str:
        return self.table(b["table"], b.get("tblpr", ""), b.get("trpr"), b.get("grid")) if "table" in b else self.paragraph(b)

    @staticmethod
    def _style_paragraph(s: dict[str, Any]) -> str:
        own = s.get("ppr", "") + (f'<w:outlineLvl w:val="{s["outline"]}"/>' if s.get("outline") is not None else "")
        return f"<w:pPr>{own}</w:pPr>" if own else ""

    def styles_xml(self, defaults: dict[str, Any]) -> str:
        out = [f"<w:docDefaults><w:rPrDefault>{run_properties(defaults) or '<w:rPr/>'}</w:rPrDefault></w:docDefaults>"]
        for s in self.styles:
            props = "".join((
                f'<w:name w:val="{escape(s["name"])}"/>', f'<w:basedOn w:val="{escape(s["base"])}"/>' if s.get("base") else "",
                s.get("raw", ""), self._style_paragraph(s), run_properties(s), s.get("more", "")))
            out.append(f'<w:style w:type="{s.get("kind", "paragraph")}"{" w:default=\"1\"" if s.get("default") else ""} w:styleId="{escape(s["id"])}">{props}</w:style>')
        return f"{HEAD}<w:styles {NS}>{''.join(out)}</w:styles>"


def build(doc: dict[str, Any]) -> list[tuple[str, bytes]]:
    """Parts of a package from {"blocks", "styles", "defaults", "lists", "notes", "comments", "stories", "media"}."""
    w = Writer(doc.get("styles"))
    w.rel("styles", "styles.xml")
    overrides = [("word/document.xml", MAIN_TYPE), ("word/styles.xml", WML + "styles+xml")]
    extra: list[tuple[str, str]] = []
    if doc.get("lists"):
        w.rel("numbering", "numbering.xml")
        overrides.append(("word/numbering.xml", WML + "numbering+xml"))
        shapes = "".join(
            f'<w:abstractNum w:abstractNumId="{k}">' + "".join(f'<w:lvl w:ilvl="{n}"><w:start w:val="{v.get("start", 1)}"/><w:numFmt w:val="{v["fmt"]}"/><w:lvlText w:val="{escape(v["text"])}"/></w:lvl>' for n, v in enumerate(levels)) + "</w:abstractNum>"
            for k, levels in enumerate(doc["lists"]))
        nums = "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(len(doc["lists"])))
        extra.append(("word/numbering.xml", f"{HEAD}<w:numbering {NS}>{shapes}{nums}</w:numbering>"))
    for kind, root, item in (("footnotes", "footnotes", "footnote"), ("comments", "comments", "comment")):
        entries = doc.get("notes" if kind == "footnotes" else "comments")
        if entries:
            w.rel(kind, f"{kind}.xml")
            overrides.append((f"word/{kind}.xml", WML + f"{kind}+xml"))
            body = "".join(f'<w:{item} w:id="{e["id"]}"{f" w:author=\"{escape(e["author"])}\"" if e.get("author") else ""}{f" w:date=\"{e["date"]}\"" if e.get("date") else ""}>{w.paragraph({"runs": [{"t": e["t"]}, *e.get("runs", [])], "para_id": e.get("para_id")})}{"".join(map(w.block, e.get("more", [])))}</w:{item}>' for e in entries)
            extra.append((f"word/{kind}.xml", f"{HEAD}<w:{root} {NS}>{body}</w:{root}>"))
    if any(e.get("para_id") for e in doc.get("comments", [])):
        w.rel("commentsExtended", "commentsExtended.xml")
        body = "".join(f'<w15:commentEx w15:paraId="{e["para_id"]}"{f" w15:paraIdParent=\"{e["parent"]}\"" if e.get("parent") else ""} w15:done="{e.get("done", "0")}"/>' for e in doc["comments"])
        extra.append(("word/commentsExtended.xml", f"{HEAD}<w15:commentsEx {NS}>{body}</w15:commentsEx>"))
    rids = {}
    for name, text in doc.get("stories", {}).items():  # header1 or footer1 and so on
        kind = name.rstrip("0123456789")
        rids[name] = w.rel(kind, f"{name}.xml")
        overrides.append((f"word/{name}.xml", WML + f"{kind}+xml"))
        tag = "hdr" if kind == "header" else "ftr"
        extra.append((f"word/{name}.xml", f"{HEAD}<w:{tag} {NS}>{w.paragraph({'runs': [{'t': text}]})}</w:{tag}>"))
    # other parts of the main one as they are: settings, theme, fontTable
    for name, text in doc.get("raw_parts", {}).items():
        w.rel(doc.get("rel_types", {}).get(name, name), f"{name}.xml")
        extra.append((f"word/{name}.xml", HEAD + text))
    media = doc.get("media", {})
    for name in media:
        w.rel("image", f"media/{name}")

    def named(section: dict[str, Any]) -> dict[str, Any]:
        return {**section, "refs": [(k, v, rids[n]) for k, v, n in section.get("refs", [])]}

    body = "".join(w.block({**b, "sect": named(b["sect"])} if "sect" in b else b) for b in doc["blocks"])
    body += w.section(named(doc.get("sect", {})))
    rels = "".join(f'<Relationship Id="{i}" Type="{k if "//" in k else OFFICE + k}" Target="{escape(t)}"{" TargetMode=\"External\"" if x else ""}/>' for i, k, t, x in w.rels)
    space = "http://schemas.openxmlformats.org/package/2006/"
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in overrides)
    made = [
        ("[Content_Types].xml", f'{HEAD}<Types xmlns="{space}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{types}</Types>'),
        ("_rels/.rels", f'{HEAD}<Relationships xmlns="{space}relationships"><Relationship Id="rId1" Type="{OFFICE}officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f"{HEAD}<w:document {NS}><w:body>{body}</w:body></w:document>"),
        ("word/_rels/document.xml.rels", f'{HEAD}<Relationships xmlns="{space}relationships">{rels}</Relationships>'),
        ("word/styles.xml", w.styles_xml(doc.get("defaults", {}))),
        *extra,
    ]
    return [(n, t.encode()) for n, t in made] + [(f"word/media/{n}", b) for n, b in media.items()] + list(doc.get("other_parts", {}).items())


@lru_cache(256)
def _package_again(described: bytes) -> bytes:
    return zip_parts(build(marshal.loads(described)))


def packed(doc: dict[str, Any]) -> bytes:
    """The archive of a described document; small documents that come again are written once."""
    try:
        described = marshal.dumps(doc, 2)
    except ValueError:  # something that is not plain data
        return zip_parts(build(doc))
    return _package_again(described) if len(described) <= SMALL else zip_parts(build(doc))


#: Packages that a task makes and reads at most, about; and so many that another task is worth its start.
PER_TASK, WORTH = 10_000, 64
#: Bytes of text of a task, about, and what an entry of a list counts for.
TASK_BYTES, ENTRY = 8 << 20, 100


def tasks_for(df: DataFrame) -> int:
    """Enough tasks for all cores, and so many that a task's share of df, by rows and by size, does not grow with it."""
    weights = [F.octet_length(f.name) if isinstance(f.dataType, StringType) else ENTRY * F.size(f.name) for f in df.schema if isinstance(f.dataType, StringType | ArrayType)]
    size = sum((F.coalesce(F.sum(F.coalesce(w, F.lit(0)).cast("long")), F.lit(0)) for w in weights), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), size).first()
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PER_TASK), -(-size // TASK_BYTES))
    return max(1, min(most, -(-rows // WORTH)))


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df dealt by doc_id to so many tasks as it needs: rows that packages are made from are small, so files of very many of
    them are read as one or a few partitions."""
    return df.repartition(tasks or tasks_for(df), "doc_id")


def make_packages(df: DataFrame, describe: Callable[[dict[str, Any]], dict[str, Any]], tasks: int | None = None) -> DataFrame:
    """(doc_id, content): a package for each row of df (a column doc_id and what describe needs), dealt by doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                yield pa.record_batch([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([packed(describe(r)) for r in rows], pa.binary())], ["doc_id", "content"])

    return spread(df.withColumn("doc_id", F.col("doc_id").cast("long")), tasks).mapInArrow(run, "doc_id long, content binary")
