"""Packages as node tables: one row for each relationship, style, list level, block, inline, cell, property set and story.

A package is opened once and each of its XML parts parsed once; all tables come out of that one pass, and what each part
is follows from the package's relationships, not from its name. A property that is not declared is null, never a
default, so that cascades can coalesce.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import package as packages_
from . import xml
from .package import resolve_target

W, W14, W15, A = xml.W, xml.W14, xml.W15, xml.A
# What turns a flag off, and the codes of list number formats.
OFF = {"false", "0", "off"}
NUMBER_FORMATS = {"decimal": 0, "upperRoman": 1, "lowerRoman": 2, "upperLetter": 3, "lowerLetter": 4, "ordinal": 5, "bullet": 23, "none": 255}

_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
    "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
STORY = ("main", "header", "footer")


class Package:
    """The parts of one package, with their roles; XML is parsed when first asked for."""

    def __init__(self, parts: list[tuple[str, bytes]]):
        self.parts = parts
        self.roles = packages_.roles(parts)
        self._roots: dict[str, xml.Element | None] = {}
        self._bytes = dict(parts)

    def root(self, name: str) -> xml.Element | None:
        """The root of a part, null if it is not XML."""
        if name not in self._roots:
            try:
                # stories differ from package to package, the other parts are often those of the same few templates
                self._roots[name] = (xml.parse if self.roles.get(name) in STORY else xml.parse_again)(self._bytes[name])
            except ValueError:
                self._roots[name] = None
        return self._roots[name]

    def of(self, *roles: str) -> Iterator[tuple[str, xml.Element]]:
        """(name, root) of the parts with one of the roles, in the package's order."""
        for name, _ in self.parts:
            if self.roles.get(name) in roles and self.root(name) is not None:
                yield name, self.root(name)

    def rows(self, make: Callable[[str, xml.Element], Iterator[tuple]], name: str) -> Iterable[tuple]:
        """The rows that make gives of a part, worked out once for small parts that come again, as styles do."""
        data = self._bytes[name]
        return _rows_again(make, name, data) if len(data) <= xml.SMALL else make(name, self.root(name))

    @cached_property
    def main(self) -> str | None:
        return next((n for n, r in self.roles.items() if r == "main"), None)


@lru_cache(256)
def _rows_again(make: Callable[[str, xml.Element], Iterator[tuple]], name: str, data: bytes) -> list[tuple]:
    return list(make(name, xml.parse_again(data)))


#: Node tables by name: their columns but doc_id, and their rows of a package.
TABLES: dict[str, tuple[str, Callable[[Package], Iterator[tuple]]]] = {}


#: Tables that are large or seldom needed: they are made only when named.
ON_DEMAND: set[str] = set()


def table(columns: str, on_demand: bool = False):
    def add(f: Callable[[Package], Iterator[tuple]]):
        TABLES[f.__name__] = (columns, f)
        if on_demand:
            ON_DEMAND.add(f.__name__)
        return f

    return add


def _fields(columns: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _KINDS[k]) for n, k in (c.split(" ") for c in columns.split(", "))]


class _Kept:
    """The rows of small packages that were shredded last, by their bytes; at most so many rows."""

    ROWS = 20_000

    def __init__(self):
        self._kept: OrderedDict[bytes, tuple[dict[str, list[tuple]], int]] = OrderedDict()
        self._rows = 0

    def get(self, content: bytes) -> dict[str, list[tuple]] | None:
        if content not in self._kept:
            return None
        self._kept.move_to_end(content)
        return self._kept[content][0]

    def put(self, content: bytes, found: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
        n = 1 + sum(map(len, found.values()))
        self._kept[content] = (found, n)
        self._rows += n
        while self._rows > self.ROWS:
            self._rows -= self._kept.popitem(last=False)[1][1]
        return found


class _Held:
    """Rows of a node table, those of equal packages once, and which of them each document has."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0
        self._ids: list[int] = []
        self._starts: list[int] = []
        self._counts: list[int] = []
        self._at: dict[int, tuple[list[tuple], int]] = {}

    def add(self, doc_id: int, rows: Iterable[tuple]) -> None:
        """Adds the rows of a document; one list that comes again, for an equal package, is held once."""
        known = self._at.get(id(rows))
        start = len(self.rows) if known is None else known[1]
        if known is None:
            self.rows.extend(rows)
            if isinstance(rows, list):
                self._at[id(rows)] = (rows, start)  # with the list, so that its id is not another's meanwhile
        count = len(self.rows) - start if known is None else len(known[0])
        if count:
            self._ids.append(doc_id)
            self._starts.append(start)
            self._counts.append(count)
            self.size += count

    def full(self) -> bool:
        return len(self.rows) > 5000 or self.size > 50_000

    def dealt(self) -> tuple[pa.Array, pa.Array | None]:
        """The documents' ids, each as often as it has rows, and the places of those rows; null if all are as they stand."""
        counts = np.array(self._counts)
        ids = pa.array(self._ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        if self.size == len(self.rows):
            return ids, None
        return ids, pa.array(np.arange(self.size) + np.repeat(np.array(self._starts) - np.cumsum(counts) + counts, counts))


def everything(packages: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Node tables of packages (doc_id, content), all or those wanted, in one: doc_id, node (the table), a struct for each table."""
    tables = {n: t for n, t in TABLES.items() if wanted is None or n in wanted}
    kinds = {name: pa.struct(_fields(columns)) for name, (columns, _) in tables.items()}
    schema = "doc_id long, node string, " + ", ".join(f"{name} struct<{', '.join(c.replace(' ', ': ', 1) for c in columns.split(', '))}>" for name, (columns, _) in tables.items())
    names = ["doc_id", "node", *tables]

    def batch(node: str, held: _Held) -> pa.RecordBatch:
        own = [pa.array(list(c), k) for c, (_, k) in zip(zip(*held.rows, strict=True), _fields(tables[node][0]), strict=True)]
        ids, at = held.dealt()
        struct = pa.StructArray.from_arrays(own if at is None else [c.take(at) for c in own], fields=list(kinds[node]))
        columns = [ids, pa.array([node] * len(ids)), *(struct if n == node else pa.nulls(len(ids), k) for n, k in kinds.items())]
        return pa.record_batch(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: _Held() for n in tables}
        kept = _Kept()
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    if not content.is_valid:
                        raise ValueError("there is no content: the file was not read, or is over the limit")
                    data = content.as_py()
                    found = kept.get(data)
                    if found is None:
                        opened = Package(packages_.load(data))
                        found = {node: rows_of(opened) for node, (_, rows_of) in tables.items()}
                        if len(data) <= xml.SMALL:
                            found = kept.put(data, {node: list(rows) for node, rows in found.items()})
                except ValueError as e:
                    if "load_errors" not in held:
                        continue
                    found = {"load_errors": [(str(e),)]}
                for node, rows in found.items():
                    own = held[node]
                    own.add(doc_id, rows)
                    if own.full():
                        yield batch(node, own)
                        held[node] = _Held()
        for node, own in held.items():
            if own.rows:
                yield batch(node, own)

    return packages.select(packages["doc_id"].cast("long").alias("doc_id"), "content").mapInArrow(run, schema)


@table("message string")
def load_errors(_: Package) -> Iterator[tuple]:
    """Packages that cannot be opened."""
    return iter(())


@table("main_part string")
def loaded(p: Package) -> Iterator[tuple]:
    """Packages that could be opened, whether or not they hold anything."""
    yield (p.main,)


def on_off(parent: xml.Element | None, tag: str) -> bool | None:
    """Null if absent; true if present, unless its value says off."""
    e = None if parent is None else parent.find(W + tag)
    return None if e is None else (e.get(W + "val") or "true").lower() not in OFF


def whole(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def half_points(value: str | None) -> float | None:
    """A size in half points, or with a unit, as points in whole halves."""
    if value is None:
        return None
    units = {"pt": 2.0, "in": 144.0, "cm": 144 / 2.54, "mm": 14.4 / 2.54, "pc": 24.0, "pi": 24.0}
    try:
        n = float(value[:-2]) * units[value[-2:]] if value[-2:] in units else float(value)
    except ValueError:
        return None
    return int(n) / 2 if n >= 0 else None


@table("owner_part string, rid string, rel_type string, target string, external boolean, owner_role string, ord int, type_uri string")
def relationships(p: Package) -> Iterator[tuple]:
    """Internal targets are part names, null if outside the package."""
    for name, _ in p.parts:
        if name.endswith(".rels") and p.root(name) is not None:
            folder, _, base = name.rpartition("_rels/")
            owner = folder + base.removesuffix(".rels")
            for k, r in enumerate(p.root(name).all(xml.RELS + "Relationship")):
                external, target = r.get("TargetMode") == "External", r.get("Target") or ""
                if not external:
                    try:
                        target = resolve_target(owner, target)
                    except ValueError:
                        target = None
                yield owner, r.get("Id"), (r.get("Type") or "").rpartition("/")[2], target, external, p.roles.get(owner), k, r.get("Type")


@table("scope string, key string, type string")
def content_types(p: Package) -> Iterator[tuple]:
    root = p.root("[Content_Types].xml") if any(n == "[Content_Types].xml" for n, _ in p.parts) else None
    for e in root.children if root else ():
        scope = e.tag.rpartition("}")[2]
        yield scope, (e.get("PartName") or "").lstrip("/") if scope == "Override" else e.get("Extension"), e.get("ContentType")


def chain(style_id: str | None, bases: dict[str, str | None]) -> list[str]:
    """A style and those it is based on, nearest first; a cycle ends where it would repeat, a missing base ends it."""
    out: list[str] = []
    while style_id in bases and style_id not in out:
        out.append(style_id)
        style_id = bases[style_id]
    return out


STYLE_FLAGS = ("b", "i", "caps", "smallCaps", "vanish")


@table("style_id string, name string, kind string, base_id string, is_default boolean, ord int, outline int, num_id int, b boolean, i boolean, caps boolean, smallCaps boolean, vanish boolean, size double, chain array<string>, next_id string, priority int, quick boolean, hidden boolean, custom boolean, num_level int")
def styles(p: Package) -> Iterator[tuple]:
    """Styles with what they declare and the chain of their bases; the document defaults are the row of kind ``defaults``."""
    for name, _ in p.of("styles"):
        yield from p.rows(_style_rows, name)


def _style_rows(_: str, root: xml.Element) -> Iterator[tuple]:
    def font(e: xml.Element | None) -> tuple:
        r = None if e is None else e.find(W + "rPr")
        return (*(on_off(r, t) for t in STYLE_FLAGS), half_points(None if r is None else r.val("sz")))

    flag = lambda raw: (raw or "0").lower() not in OFF | {""}
    d = root.find(W + "docDefaults")
    if d is not None:
        yield (None, None, "defaults", None, False, -1, None, None, *font(d.find(W + "rPrDefault")), [], None, None, None, None, None, None)
    bases = {s.get(W + "styleId"): s.val("basedOn") for s in root.all(W + "style") if s.get(W + "styleId") is not None}
    for k, s in enumerate(root.all(W + "style")):
        own = s.find(W + "pPr")
        num = None if own is None else own.find(W + "numPr")
        ident = s.get(W + "styleId")
        yield (
            ident, s.val("name"), s.get(W + "type", "paragraph"), s.val("basedOn"), flag(s.get(W + "default")),
            k, whole(None if own is None else own.val("outlineLvl")), None if num is None else whole(num.val("numId")) or 0, *font(s), chain(ident, bases),
            s.val("next") or ident, whole(s.val("uiPriority")), on_off(s, "qFormat") or False, on_off(s, "semiHidden") or False, flag(s.get(W + "customStyle")), whole(None if num is None else num.val("ilvl")))


@table("list_id int, level int, number_style int, number_format string, start_at int, alignment string, suffix string, restart int, number_position double, text_position double, multilevel boolean")
def list_levels(p: Package) -> Iterator[tuple]:
    """Levels of each concrete list, with the overrides of their start; numbers from the abstract definitions."""
    for _, root in p.of("numbering"):
        shapes = {a.get(W + "abstractNumId"): a for a in root.all(W + "abstractNum")}
        for n in root.all(W + "num"):
            shape = shapes.get(n.val("abstractNumId"))
            if shape is None:
                continue
            starts = {o.get(W + "ilvl"): whole(o.val("startOverride")) for o in n.all(W + "lvlOverride")}
            own = {o.get(W + "ilvl"): o.find(W + "lvl") for o in n.all(W + "lvlOverride")}
            levels, kind = shape.all(W + "lvl"), shape.val("multiLevelType")
            several = kind in ("multilevel", "hybridMultilevel") or not kind and len(levels) > 1
            for level in levels:
                k = level.get(W + "ilvl")
                level = own.get(k) or level
                start = starts.get(k)
                if start is None:
                    start = whole(level.val("start")) or 0
                ppr = level.find(W + "pPr")
                ind = None if ppr is None else ppr.find(W + "ind")
                place = lambda a, ind=ind: None if ind is None else whole(ind.get(W + a))
                left, hanging, first = place("left"), place("hanging"), place("firstLine")
                number = None if left is None else (left - (hanging or 0)) / 20
                text = left / 20 if left is not None and (hanging is not None or first is not None) else 0.0 if first is not None and left is None else None
                yield (
                    whole(n.get(W + "numId")), whole(k), 23 if level.val("numFmt") is None else NUMBER_FORMATS.get(level.val("numFmt"), 0), level.val("lvlText") or "", start,
                    level.val("lvlJc"), level.val("suff") or "tab", whole(level.val("lvlRestart")), number, text, several)


_SDT, _P, _TBL, _VAL = W + "sdt", W + "p", W + "tbl", W + "val"


def _unwrapped(parent: xml.Element) -> Iterator[xml.Element]:
    """Children, with content controls opened, but for placeholders, and of alternatives the choice."""
    for c in parent.children:
        if c.tag == _SDT:
            inner, own = c.find(W + "sdtContent"), c.find(W + "sdtPr")
            if inner is not None and not (own is not None and own.find(W + "showingPlcHdr") is not None):
                yield from _unwrapped(inner)
        elif c.tag.endswith("}AlternateContent"):
            choice = next((x for x in c.children if x.tag.endswith("}Choice")), None)
            if choice is not None:
                yield from _unwrapped(choice)
        else:
            yield c


def _body(root: xml.Element) -> xml.Element:
    return root.find(W + "body") or root


def _placed(parent: xml.Element, path: list[int], style: str | None) -> Iterator[tuple[list[int], xml.Element, str | None]]:
    """Paragraphs and tables in document order, each with the style that its innermost table, or a table itself, names;
    a cell's content has the path of its table, then row, cell, place."""
    place = 0
    for c in _unwrapped(parent):
        if c.tag in (_P, _TBL):
            here = [*path, place]
            place += 1
            if c.tag == _P:
                yield here, c, style
                continue
            props = c.find(W + "tblPr")
            own = (None if props is None else props.val("tblStyle")) or None
            yield here, c, own
            for r, row in enumerate(x for x in _unwrapped(c) if x.tag == W + "tr"):
                for k, cell in enumerate(x for x in _unwrapped(row) if x.tag == W + "tc"):
                    yield from _placed(cell, [*here, r, k], own)


def _blocks(parent: xml.Element, path: list[int]) -> Iterator[tuple[list[int], xml.Element]]:
    for here, e, _ in _placed(parent, path, None):
        yield here, e


def _paragraph_style(e: xml.Element) -> str | None:
    own = e.find(W + "pPr") if e.tag == W + "p" else None
    return (None if own is None else own.val("pStyle")) or None


@table("part_name string, path array<int>, node_type string, style_id string, outline int, list_id int, level int, ends_section boolean, table_style string")
def blocks(p: Package) -> Iterator[tuple]:
    """Paragraphs and tables of the main story, with what paragraphs declare; ends_section marks a section's last.
    table_style is what the innermost table around a paragraph, or a table itself, names."""
    for name, root in p.of("main"):
        for path, e, table_style in _placed(_body(root), [], None):
            own = e.find(W + "pPr") if e.tag == W + "p" else None
            num = None if own is None else own.find(W + "numPr")
            yield (
                name, path, "Paragraph" if e.tag == W + "p" else "Table", None if own is None else own.val("pStyle"), whole(None if own is None else own.val("outlineLvl")),
                None if num is None else whole(num.val("numId")) or 0, whole(None if num is None else num.val("ilvl")), own is not None and own.find(W + "sectPr") is not None, table_style)


def _sections(root: xml.Element) -> Iterator[xml.Element]:
    for c in _body(root).children:
        s = c if c.tag == W + "sectPr" else c.find(W + "pPr") and c.find(W + "pPr").find(W + "sectPr")
        if s:
            yield s


@table("section int, kind string, variant string, rid string")
def section_references(p: Package) -> Iterator[tuple]:
    """The explicit header and footer references of each section."""
    for _, root in p.of("main"):
        for k, s in enumerate(_sections(root)):
            for r in s.children:
                kind = r.tag.rpartition("}")[2]
                if kind in ("headerReference", "footerReference"):
                    yield k, kind.removesuffix("Reference"), r.get(W + "type", "default"), r.get(xml.R + "id")
            yield k, "section", None, None


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _flat(e: xml.Element | None, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """Declarations as one map: ``element`` is its value or empty, ``element@attribute`` each attribute, ``outer/inner``
    what stands inside; of elements that repeat the later ones have their number behind, as in ``tabs/tab#1``."""
    out: dict[str, str] = {}
    seen: dict[str, int] = {}

    def walk(parent: xml.Element, prefix: str) -> None:
        for c in parent.children:
            tag = _local(c.tag)
            if tag in skip:
                continue
            key = prefix + tag
            n = seen.get(key, 0)
            seen[key] = n + 1
            key = f"{key}#{n}" if n else key
            out[key] = c.get(W + "val") or ""
            for a, v in c.attrs.items():
                out[f"{key}@{_local(a)}"] = v
            walk(c, key + "/")

    if e is not None:
        walk(e, "")
    return out


def _declared(owner: str, name: str, path: list[int] | None, k: int | None, ident: str | None, props: dict[str, str]) -> Iterator[tuple]:
    if props:
        yield owner, name, path, k, ident, list(props.items())


@table("owner string, part_name string, path array<int>, ord int, ident string, props map<string,string>")
def properties(p: Package) -> Iterator[tuple]:
    """What is declared on paragraphs, their marks and runs, tables, rows, cells, sections, styles and the whole
    document: one row for each that declares anything. ord is a run's, row's, cell's (row * 1024 + cell) or section's."""
    for name, root in p.of(*STORY):
        for path, e in _blocks(_body(root), []):
            if e.tag == W + "p":
                own = e.find(W + "pPr")
                yield from _declared("paragraph", name, path, None, None, _flat(own, ("rPr", "sectPr")))
                yield from _declared("mark", name, path, None, None, _flat(None if own is None else own.find(W + "rPr")))
                for k, (x, *_) in enumerate(_inlines(e, None, None)):
                    if x[0] == "Run" and x[-1] is not None:
                        yield from _declared("run", name, path, k, None, _flat(x[-1]))
            else:
                yield from _declared("table", name, path, None, None, _flat(e.find(W + "tblPr")) | {f"grid#{k}": g.get(W + "w") or "" for k, g in enumerate(e.find(W + "tblGrid").all(W + "gridCol") if e.find(W + "tblGrid") else ())})
                for r, tr in enumerate(x for x in _unwrapped(e) if x.tag == W + "tr"):
                    yield from _declared("row", name, path, r, None, _flat(tr.find(W + "trPr")))
                    for c, tc in enumerate(x for x in _unwrapped(tr) if x.tag == W + "tc"):
                        yield from _declared("cell", name, path, r * 1024 + c, None, _flat(tc.find(W + "tcPr")))
        if p.roles.get(name) == "main":
            for k, s in enumerate(_sections(root)):
                yield "section", name, None, k, None, list(_flat(s).items())
    for name, _ in p.of("styles"):
        yield from p.rows(_declared_by_styles, name)
    for name, root in p.of("settings"):
        yield from _declared("settings", name, None, None, None, _flat(root))


def _declared_by_styles(name: str, root: xml.Element) -> Iterator[tuple]:
    for s in root.all(W + "style"):
        ident = s.get(W + "styleId")
        for owner, tag in (("style_paragraph", "pPr"), ("style_run", "rPr"), ("style_table", "tblPr"), ("style_row", "trPr"), ("style_cell", "tcPr")):
            yield from _declared(owner, name, None, None, ident, _flat(s.find(W + tag), ("rPr",) if tag == "pPr" else ()))
        for k, x in enumerate(s.all(W + "tblStylePr")):
            yield from _declared("style_region", name, None, k, f"{ident}:{x.get(W + 'type')}", _flat(x))
    d = root.find(W + "docDefaults")
    for owner, tag, inner in (("default_run", "rPrDefault", "rPr"), ("default_paragraph", "pPrDefault", "pPr")):
        x = None if d is None else d.find(W + tag)
        yield from _declared(owner, name, None, None, None, _flat(None if x is None else x.find(W + inner)))


@table("kind string, slot string, value string")
def theme_slots(p: Package) -> Iterator[tuple]:
    """Fonts and colours that the theme names; a colour also under the other names it goes by."""
    # Other names of theme colours.
    other = {"lt1": ("bg1", "background1"), "lt2": ("bg2", "background2"), "dk1": ("tx1", "text1"), "dk2": ("tx2", "text2")}
    for _, root in p.of("theme"):
        all_ = root.find(A + "themeElements")
        fonts, colours = (None if all_ is None else all_.find(A + t) for t in ("fontScheme", "clrScheme"))
        for group, prefix in (("majorFont", "major"), ("minorFont", "minor")):
            g = None if fonts is None else fonts.find(A + group)
            face = None if g is None or g.find(A + "latin") is None else g.find(A + "latin").get("typeface")
            for script in ("HAnsi", "Ascii", "Bidi") if face else ():
                yield "font", prefix + script, face
        found: dict[str, str] = {}
        for slot in colours.children if colours is not None else ():
            plain, system = slot.find(A + "srgbClr"), slot.find(A + "sysClr")
            value = plain.get("val") if plain is not None else system.get("lastClr") if system is not None else None
            if value:
                found[_local(slot.tag)] = value.upper()
        for name, value in found.items():
            yield "color", name, value
            for alias in other.get(name, ()):
                if alias not in found:
                    yield "color", alias, value


@table("name string, ord int, alternative string, charset string, family string, pitch string, embedded boolean")
def font_table(p: Package) -> Iterator[tuple]:
    """Registered fonts in order; a name that comes again, in whatever case, is the same font."""
    for _, root in p.of("fontTable"):
        for k, f in enumerate(root.all(W + "font")):
            yield f.get(W + "name"), k, f.val("altName"), (f.find(W + "charset").get(W + "val") if f.find(W + "charset") else None), f.val("family"), f.val("pitch"), any(_local(c.tag).startswith("embed") for c in f.children)


def _word_text(e: xml.Element) -> str:
    """The text of a text element: blanks around it go unless they are to be preserved; line ends are blanks."""
    if e.get(xml.SPACE) == "preserve":
        text = e.text.lstrip("\n")
    else:
        text = e.text.strip(" \t\r\n").replace("\t", " ")
    return text.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")


# The characters that breaks and tabs stand for.
_BREAKS = {"page": "\f", "column": "\v"}


def _piece(c: xml.Element) -> str:
    tag = _local(c.tag)
    if tag == "t":
        return _word_text(c)
    if tag == "instrText":
        return c.text
    if tag == "br":
        return _BREAKS.get(c.get(W + "type") or "", "\n")
    return {"tab": "\t", "cr": "\r"}.get(tag, "")


def _run_text(r: xml.Element) -> str:
    return "".join(map(_piece, r.children))


_FIELD = {"begin": "FieldStart", "separate": "FieldSeparator", "end": "FieldEnd"}


def _drawing(x: xml.Element) -> tuple[str | None, str | None]:
    """Alternative text and the relationship of the picture of a drawing."""
    doc = next((e for e in x.walk() if _local(e.tag) == "docPr"), None)
    blip = next((e for e in x.walk() if e.tag == A + "blip" or _local(e.tag) == "imagedata"), None)
    return None if doc is None else doc.get("descr"), None if blip is None else blip.get(xml.R + "embed") or blip.get(xml.R + "id")


_RUN_STYLE, _RUN_FLAGS, _RUN_SIZE = W + "rStyle", tuple(W + t for t in STYLE_FLAGS), W + "sz"
_UNDECLARED = (None,) * (len(STYLE_FLAGS) + 3)


def _run_properties(own: xml.Element | None) -> tuple:
    """A run's style, flags, size and declarations."""
    if own is None:
        return _UNDECLARED
    by = {c.tag: c for c in reversed(own.children)}
    value = lambda tag: by[tag].get(_VAL) if tag in by else None
    return value(_RUN_STYLE), *(((by[t].get(_VAL) or "true").lower() not in OFF if t in by else None) for t in _RUN_FLAGS), half_points(value(_RUN_SIZE)), own


def _inlines(parent: xml.Element, rid: str | None, anchor: str | None) -> Iterator[tuple[tuple, xml.Element | None]]:
    """((kind, text, ident, rid, anchor, char_style, flags..., size, the run's declarations), drawing) in order: a mark
    inside a run ends the text before it."""
    for c in _unwrapped(parent):
        tag = _local(c.tag)
        if tag == "hyperlink":
            yield from _inlines(c, c.get(xml.R + "id"), c.get(W + "anchor"))
        elif tag in ("ins", "smartTag", "fldSimple"):
            yield from _inlines(c, rid, anchor)
        elif tag in ("commentRangeStart", "commentRangeEnd"):
            yield ("CommentStart" if tag == "commentRangeStart" else "CommentEnd", None, c.get(W + "id"), *[None] * 10), None
        elif tag in ("bookmarkStart", "bookmarkEnd"):
            yield ("BookmarkStart" if tag == "bookmarkStart" else "BookmarkEnd", c.get(W + "name"), c.get(W + "id"), *[None] * 10), None
        elif tag == "r":
            own = c.find(W + "rPr")
            props = _run_properties(own)
            text = ""
            for x in c.children:
                t, mark, drawing = _local(x.tag), None, None
                if t == "fldChar":
                    mark = (_FIELD.get(x.get(W + "fldCharType") or "", "FieldEnd"), None, None, None, None, *props)
                elif t in ("footnoteReference", "endnoteReference"):
                    mark = ("NoteReference", t.removesuffix("Reference"), x.get(W + "id"), None, None, *props)
                elif t == "commentReference":
                    mark = ("CommentMarker", None, x.get(W + "id"), None, None, *props)
                elif t in ("drawing", "pict"):
                    alt, image = _drawing(x)
                    mark, drawing = ("Drawing", alt, None, image, None, *props), x
                if mark:
                    if text:
                        yield ("Run", text, None, rid, anchor, *props), None
                    text = ""
                    yield mark, drawing
                else:
                    text += _piece(x)
            if text:
                yield ("Run", text, None, rid, anchor, *props), None


@table("part_name string, block_path array<int>, ord int, kind string, text string, ident string, rid string, anchor string, char_style string, b boolean, i boolean, caps boolean, smallCaps boolean, vanish boolean, size double, role string, paragraph_style string, table_style string")
def inlines(p: Package) -> Iterator[tuple]:
    """Runs and marks of paragraphs in order: Run, FieldStart, FieldSeparator, FieldEnd, BookmarkStart, BookmarkEnd,
    CommentStart, CommentEnd, NoteReference, CommentMarker, Drawing."""
    for name, root in p.of(*STORY):
        for path, e, table_style in _placed(_body(root), [], None):
            if e.tag == W + "p":
                style = _paragraph_style(e)
                for k, (x, _) in enumerate(_inlines(e, None, None)):
                    yield (name, path, k, *x[:-1], p.roles[name], style, table_style)


@table("part_name string, block_path array<int>, ord int, kind string, rid string, alternative_text string, name string, width double, height double, x double, y double, horizontal_from string, vertical_from string, wrap string, behind boolean")
def drawings(p: Package) -> Iterator[tuple]:
    """Inline and anchored drawings: size and place in points, what they are placed from, and how text goes around them."""
    points = lambda v: None if whole(v) is None else whole(v) / 12700
    for name, root in p.of(*STORY):
        for path, e in _blocks(_body(root), []):
            for k, (x, d) in enumerate(_inlines(e, None, None) if e.tag == W + "p" else ()):
                shape = next((c for c in d.children if _local(c.tag) in ("inline", "anchor")), None) if d is not None else None
                if shape is None:
                    continue
                by = {_local(c.tag): c for c in shape.children}
                extent, doc = by.get("extent"), by.get("docPr")
                wrap = next((t.removeprefix("wrap") for t in by if t.startswith("wrap")), None)
                spot = {}
                for axis in ("positionH", "positionV"):
                    offset = next((c.text for c in by[axis].children if _local(c.tag) == "posOffset"), None) if axis in by else None
                    spot[axis] = (by[axis].get("relativeFrom") if axis in by else None, points(offset))
                yield (
                    name, path, k, _local(shape.tag), x[3], None if doc is None else doc.get("descr"), None if doc is None else doc.get("name"),
                    points(extent.get("cx")) if extent else None, points(extent.get("cy")) if extent else None, spot["positionH"][1], spot["positionV"][1],
                    spot["positionH"][0], spot["positionV"][0], wrap, shape.get("behindDoc") in ("1", "true") if _local(shape.tag) == "anchor" else None)


@table("part_name string, role string, block_path array<int>, ord int, shape int, depth int, off_x array<double>, off_y array<double>, ratio_x array<double>, ratio_y array<double>, child_x double, child_y double, x double, y double, width double, height double, anchor_x double, anchor_y double, horizontal_from string, vertical_from string, fill string, text string", on_demand=True)
def placed_shapes(p: Package) -> Iterator[tuple]:
    """Shapes of anchored drawings that are no pictures, those of groups each by itself. Of the groups around a shape, from
    the outermost on: where each stands in the one before, and how many points one of its own units is; child_x and
    child_y are where the innermost one's units begin. All in points, but for the ratios."""
    def number(e: xml.Element | None, a: str) -> float:
        return (whole(e.get(a)) or 0) / 12700 if e is not None else 0.0

    def inner(e: xml.Element | None, *tags: str) -> xml.Element | None:
        for tag in tags:
            e = None if e is None else next((c for c in e.children if _local(c.tag) == tag), None)
        return e

    def flat(e: xml.Element, groups: list[tuple]) -> Iterator[tuple[xml.Element, list[tuple]]]:
        for c in e.children:
            tag = _local(c.tag)
            if tag == "wsp":
                yield c, groups
            elif tag in ("wgp", "grpSp"):
                yield from flat(c, [*groups, frame(c)])

    def frame(g: xml.Element) -> tuple:
        at = inner(g, "grpSpPr", "xfrm") or inner(g, "xfrm")
        ext, own = inner(at, "ext"), inner(at, "chExt")
        ratio = [(whole(ext.get(a)) or 0) / max(1, whole(own.get(a)) or 0) if ext is not None and own is not None else 1.0 for a in ("cx", "cy")]
        return number(inner(at, "off"), "x"), number(inner(at, "off"), "y"), *ratio, number(inner(at, "chOff"), "x"), number(inner(at, "chOff"), "y")

    for name, root in p.of(*STORY):
        for path, e in _blocks(_body(root), []):
            for k, (_, d) in enumerate(_inlines(e, None, None) if e.tag == W + "p" else ()):
                anchor = inner(d, "anchor")
                if anchor is None:
                    continue
                spot = {}
                for axis in ("positionH", "positionV"):
                    at = inner(anchor, axis)
                    offset = inner(at, "posOffset")
                    spot[axis] = ((whole(offset.text) or 0) / 12700 if offset is not None else 0.0, at.get("relativeFrom", "page") if at is not None else "page")
                top = next((x for x in anchor.walk() if _local(x.tag) in ("wgp", "wsp")), None)
                grouped = top is not None and _local(top.tag) == "wgp"
                if top is None or not grouped and any(x.tag == A + "blip" for x in anchor.walk()):
                    continue
                for n, (s, groups) in enumerate(flat(top, [frame(top)]) if grouped else [(top, [])]):
                    at = inner(s, "spPr", "xfrm")
                    off, ext = (inner(at, "off"), inner(at, "ext")) if grouped else (None, inner(anchor, "extent"))
                    if ext is None or grouped and off is None:
                        continue
                    fill = inner(s, "spPr", "solidFill", "srgbClr")
                    lines = ["".join(_run_text(r) for r in x.walk() if r.tag == W + "r") for x in s.walk() if x.tag == W + "p"]
                    yield (
                        name, p.roles[name], path, k, n, len(groups), *([g[i] for g in groups] for i in range(4)), groups[-1][4] if groups else 0.0, groups[-1][5] if groups else 0.0,
                        number(off, "x"), number(off, "y"), number(ext, "cx"), number(ext, "cy"), spot["positionH"][0], spot["positionV"][0], spot["positionH"][1], spot["positionV"][1],
                        None if fill is None else fill.get("val"), "\n".join(lines))


@table("table_path array<int>, row int, cell int, grid_span int, horizontal_merge int, vertical_merge int")
def cells(p: Package) -> Iterator[tuple]:
    """Cells of tables: 0 no merge, 1 first, 2 continued."""
    def code(own: xml.Element | None, tag: str) -> int:
        e = None if own is None else own.find(W + tag)
        return 0 if e is None else 1 if e.get(W + "val") == "restart" else 2

    for _, root in p.of("main"):
        for path, e in _blocks(_body(root), []):
            for r, row in enumerate(x for x in _unwrapped(e) if x.tag == W + "tr") if e.tag == W + "tbl" else ():
                for k, cell in enumerate(x for x in _unwrapped(row) if x.tag == W + "tc"):
                    own = cell.find(W + "tcPr")
                    span = whole(None if own is None else own.val("gridSpan")) or 1
                    yield path, r, k, min(max(span, 1), 1024), code(own, "hMerge"), code(own, "vMerge")


def _entries(p: Package, name: str, root: xml.Element) -> Iterator[tuple[int, str | None, str | None, str | None, xml.Element]]:
    """(number, kind, id, type of note, element) of the stories in a part: each note or comment, a header or footer as one."""
    if p.roles[name] in ("header", "footer"):
        yield 0, None, None, None, root
        return
    for k, e in enumerate(root.children):
        kind = _local(e.tag)
        if kind in ("footnote", "endnote", "comment"):
            yield k, kind, e.get(W + "id"), None if kind == "comment" else e.get(W + "type") or "normal", e


OTHER_STORIES = ("header", "footer", "footnotes", "endnotes", "comments")


@table("part_name string, role string, story int, story_kind string, story_id string, note_type string, path array<int>, node_type string, style_id string, table_style string", on_demand=True)
def story_blocks(p: Package) -> Iterator[tuple]:
    """Paragraphs and tables of headers, footers, notes and comments; the path of those in notes and comments begins with
    the number of the story in its part."""
    for name, root in p.of(*OTHER_STORIES):
        for k, kind, ident, note_type, entry in _entries(p, name, root):
            for path, e, table_style in _placed(entry, [] if kind is None else [k], None):
                yield name, p.roles[name], k, kind, ident, note_type, path, "Paragraph" if e.tag == W + "p" else "Table", _paragraph_style(e), table_style


@table("part_name string, block_path array<int>, ord int, kind string, text string, ident string, rid string, anchor string, char_style string, b boolean, i boolean, caps boolean, smallCaps boolean, vanish boolean, size double, role string, paragraph_style string, table_style string", on_demand=True)
def story_inlines(p: Package) -> Iterator[tuple]:
    """Runs and marks of the same, as inlines has them."""
    for name, root in p.of(*OTHER_STORIES):
        for k, kind, _, _, entry in _entries(p, name, root):
            for path, e, table_style in _placed(entry, [] if kind is None else [k], None):
                if e.tag == W + "p":
                    style = _paragraph_style(e)
                    for n, (x, _) in enumerate(_inlines(e, None, None)):
                        yield (name, path, n, *x[:-1], p.roles[name], style, table_style)


@table("kind string, identifier string, author string, text string, para_id string, part_name string, date string, initials string")
def stories(p: Package) -> Iterator[tuple]:
    """Notes and comments: kind, identifier, author, text, and the paragraph id of their last paragraph."""
    for name, root in p.of("footnotes", "endnotes", "comments"):
        for e in root.children:
            kind = _local(e.tag)
            if kind in ("footnote", "endnote", "comment") and e.get(W + "type") in (None, "normal"):
                paragraphs = [x for _, x in _blocks(e, []) if x.tag == W + "p"]
                text = "\n".join(t for x in paragraphs if (t := "".join(_run_text(r) for r in x.walk() if r.tag == W + "r")))
                yield kind, e.get(W + "id"), e.get(W + "author"), text, paragraphs[-1].get(W14 + "paraId") if paragraphs else None, name, e.get(W + "date"), e.get(W + "initials")


#: Elements that carry declarations; they and what is inside them are no nodes.
PROPERTY_ROOTS = ("pPr", "rPr", "tblPr", "trPr", "tcPr", "sectPr", "tblGrid", "tblPrEx")
# The kinds of nodes that elements are.
NODE_KINDS = {
    "document": "Document", "body": "Body", "hdr": "HeaderFooter", "ftr": "HeaderFooter", "p": "Paragraph", "r": "Run", "tbl": "Table", "tr": "Row", "tc": "Cell", "hyperlink": "Hyperlink",
    "bookmarkStart": "BookmarkStart", "bookmarkEnd": "BookmarkEnd", "commentRangeStart": "CommentRangeStart", "commentRangeEnd": "CommentRangeEnd", "drawing": "Shape", "pict": "Shape",
    "footnote": "Footnote", "endnote": "Footnote", "comment": "Comment", "sdt": "StructuredDocumentTag"}
STORIES = (*STORY, "footnotes", "endnotes", "comments")


ELEMENT = "part_name string, role string, first int, last int, parent int, depth int, place int, kind string, tag string, qname string, text string, start int, inner_start int, inner_end int, end int, property boolean, ident string, para_id string"


@table(ELEMENT, on_demand=True)
def elements(p: Package) -> Iterator[tuple]:
    """Every element of the stories with its interval: it holds the elements numbered first + 1 to last. start to end
    are its bytes in the part. property marks declarations and what is inside them. text is that of text elements, and
    the id of styles."""
    for name, body in p.parts:
        if p.roles.get(name) in STORIES:
            yield from _element_rows(body, name, p.roles[name])


@table(ELEMENT, on_demand=True)
def style_elements(p: Package) -> Iterator[tuple]:
    """The same of the styles, which outnumber the elements of a short story many times."""
    for name, body in p.parts:
        if p.roles.get(name) == "styles":
            yield from _elements_again(body, name, "styles")


def _element_rows(body: bytes, name: str, role: str) -> Iterator[tuple]:
    try:
        found = xml.spans(body)
    except ValueError:
        return
    until = -1
    for e in found:
        tag = _local(e.tag)
        own = e.tag.startswith(W)
        if own and tag in PROPERTY_ROOTS:
            until = max(until, e.last)
        kind = NODE_KINDS.get(tag, "Unknown") if own or tag == "pict" else "Unknown"
        yield (
            name, role, e.first, e.last, e.parent, e.depth, e.place, kind, tag if own else e.tag, e.qname, e.text if own and tag in ("t", "instrText", "delText") else e.attrs.get(W + "styleId"),
            e.start, e.inner_start, e.inner_end, e.end, e.first <= until, e.attrs.get(W + "id"), e.attrs.get(W14 + "paraId"))


@xml.once
def _elements_again(body: bytes, name: str, role: str) -> list[tuple]:
    return list(_element_rows(body, name, role))


@table("part_name string, role string, place int, kind string, ident string, story_kind string, story_id string, reached boolean", on_demand=True)
def annotation_marks(p: Package) -> Iterator[tuple]:
    """Every mark of notes and comments wherever it stands, in order; reached is whether reading a story's paragraphs
    comes to it."""
    # Marks that stand for annotations, and those that carry their number.
    named = {"commentRangeStart": "start", "commentRangeEnd": "end", "commentReference": "reference", "footnoteReference": "footnoteReference", "endnoteReference": "endnoteReference"}
    bare = {"annotationRef": "annotation", "footnoteRef": "footnoteRef", "endnoteRef": "endnoteRef", "separator": "separator", "continuationSeparator": "continuationSeparator"}
    for name, root in p.of(*STORIES):
        reached: set[int] = set()
        entries = [(None, None, _body(root))] if p.roles[name] in STORY else [(_local(e.tag), e.get(W + "id"), e) for e in root.children]
        for _, _, entry in entries:
            for _, e in _blocks(entry, []):
                if e.tag == W + "p":
                    reached.update(id(x) for x in _reached(e))
        place = 0
        for kind, ident, entry in entries:
            for x in entry.walk():
                tag = _local(x.tag) if x.tag.startswith(W) else ""
                if tag in named or tag in bare:
                    yield name, p.roles[name], place, named.get(tag) or bare[tag], x.get(W + "id") if tag in named else None, kind, ident, id(x) in reached
                    place += 1


def _reached(parent: xml.Element) -> Iterator[xml.Element]:
    """What reading a paragraph comes to: its inline elements, and those of its runs."""
    for c in _unwrapped(parent):
        yield c
        tag = _local(c.tag)
        if tag in ("hyperlink", "ins", "smartTag", "fldSimple"):
            yield from _reached(c)
        elif tag == "r":
            yield from c.children


@table("identifier string, place int, para_id string, date string", on_demand=True)
def comment_paragraphs(p: Package) -> Iterator[tuple]:
    """The paragraphs of comments, those of their tables too, with their ids; one row without an id for a comment without any."""
    for _, root in p.of("comments"):
        for e in root.all(W + "comment"):
            found = [x for _, x in _blocks(e, []) if x.tag == W + "p"]
            for k, x in enumerate(found):
                yield e.get(W + "id"), k, x.get(W14 + "paraId"), e.get(W + "date")
            if not found:
                yield e.get(W + "id"), None, None, e.get(W + "date")


@table("part_name string, kind string, ord int, para_id string, durable_id string, date_utc string", on_demand=True)
def comment_records(p: Package) -> Iterator[tuple]:
    """Records of modern comment metadata, of every part whose root is one; which part counts follows from relationships."""
    # Namespaces of the two kinds of parts.
    kinds = {"{http://schemas.microsoft.com/office/word/2016/wordml/cid}commentsIds": "commentId", "{http://schemas.microsoft.com/office/word/2018/wordml/cex}commentsExtensible": "commentExtensible"}
    for name, _ in p.parts:
        root = p.root(name) if name.endswith(".xml") else None
        if root is not None and root.tag in kinds:
            space = root.tag.rpartition("}")[0] + "}"
            for k, e in enumerate(root.all(space + kinds[root.tag])):
                yield name, _local(root.tag), k, e.get(space + "paraId"), e.get(space + "durableId"), e.get(space + "dateUtc")


@table("para_id string, parent_para_id string, done_raw string")
def threads(p: Package) -> Iterator[tuple]:
    for _, root in p.of("commentsExtended"):
        for e in root.all(W15 + "commentEx"):
            yield e.get(W15 + "paraId"), e.get(W15 + "paraIdParent"), e.get(W15 + "done")


# Constructs that reading leaves out or flattens.
UNSUPPORTED = ("object", "altChunk", "ins", "del", "moveFrom", "moveTo", "fldSimple", "sdt", "oMath", "oMathPara")


@table("part_name string, construct string, uses int")
def constructs(p: Package) -> Iterator[tuple]:
    """Unsupported constructs of each story part, and how often they are used."""
    for name, root in p.of(*STORY, "footnotes", "endnotes", "comments"):
        seen: dict[str, int] = {}
        for e in root.walk():
            tag = _local(e.tag)
            if tag in UNSUPPORTED:
                seen[tag] = seen.get(tag, 0) + 1
        for tag, n in sorted(seen.items()):
            yield name, tag, n


@table("part_name string, size int, is_xml boolean, role string")
def inventory(p: Package) -> Iterator[tuple]:
    """All parts; is_xml is false for one that should be XML and cannot be parsed, null for others."""
    for name, body in p.parts:
        yield name, len(body), p.root(name) is not None if name.endswith((".xml", ".rels")) else None, p.roles.get(name)
