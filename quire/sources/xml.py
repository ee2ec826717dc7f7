"""XML of packages as light element trees; document type declarations are refused."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, wraps
from xml.parsers import expat

# The namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
PKG = "{http://schemas.microsoft.com/office/2006/xmlPackage}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"

#: Parts of at most so many bytes are kept with what was made of them, a few hundred in a process.
SMALL = 16 << 10


def once[T](f: Callable[..., T]) -> Callable[..., T]:
    """f of a part's bytes, worked out once for small parts that come again: packages of one origin have their types,
    relationships and styles in common. What f gives is shared, so nobody changes it."""
    kept = lru_cache(256)(f)

    @wraps(f)
    def g(data: bytes, *more: object) -> T:
        return (kept if len(data) <= SMALL else f)(data, *more)

    return g


class Element:
    """An element; text stands before its first child, tail behind the element itself."""

    __slots__ = ("tag", "attrs", "children", "text", "tail")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.text, self.tail = tag, attrs, [], "", ""

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def find(self, tag: str) -> Element | None:
        return next((c for c in self.children if c.tag == tag), None)

    def all(self, tag: str) -> list[Element]:
        return [c for c in self.children if c.tag == tag]

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def under(self, tag: str) -> list[Element]:
        """All elements of a tag below this one, in document order."""
        return [e for e in self.walk() if e.tag == tag]

    def val(self, tag: str) -> str | None:
        c = self.find(W + tag)
        return None if c is None else c.get(W + "val")


@lru_cache(4096)
def _name(n: str) -> str:
    """A name as expat gives it, its namespace in braces; the same few come again and again."""
    return "{" + n if "}" in n else n


def parse(data: bytes) -> Element:
    """The root of an XML part; ValueError for what is not well-formed or declares a document type."""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    stack: list[Element] = []
    roots: list[Element] = []

    def start(tag: str, attrs: dict[str, str]) -> None:
        e = Element(_name(tag), {_name(k): v for k, v in attrs.items()} if attrs else attrs)
        (stack[-1].children if stack else roots).append(e)
        stack.append(e)

    def characters(text: str) -> None:
        if stack[-1].children:
            stack[-1].children[-1].tail += text
        else:
            stack[-1].text += text

    def forbidden(*_: object) -> None:
        raise ValueError("a document type declaration is not allowed")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), characters
    p.StartDoctypeDeclHandler = forbidden
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed XML: {expat.ErrorString(e.code)}") from None
    return roots[0]


parse_again = once(parse)


@dataclass(slots=True)
class Span:
    """An element and where it stands: its number in document order, the last number inside it, its place among its
    parent's elements, and its bytes: from start to end, its content from inner_start to inner_end (an empty tag has none)."""

    first: int
    last: int
    parent: int | None
    depth: int
    place: int
    tag: str
    qname: str
    attrs: dict[str, str]
    text: str
    start: int
    inner_start: int | None
    inner_end: int | None
    end: int


_TAG = re.compile(rb"""<([^\s/>]+)(?:[^>"']|"[^"]*"|'[^']*')*>""")


def in_utf8(data: bytes) -> bool:
    """Whether XML is written in UTF-8, as its first bytes say."""
    return data[:2] not in (b"\xff\xfe", b"\xfe\xff") and not re.match(rb"<\?xml[^>]*encoding\s*=\s*[\"'](?![Uu][Tt][Ff]-?8|[Uu][Ss]-)", data)


def cut(data: bytes, level: int) -> tuple[Element, dict[int, bytes]]:
    """The root of XML in UTF-8 with its elements down to a level, and of each element of that level, by its id(), the bytes
    that it takes up, on its own: prefixes that are declared around it are declared at its start. What is inside is checked
    but not made into elements. ValueError for what is not well-formed or declares a document type."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    stack: list[Element] = []
    roots: list[Element] = []
    scopes: list[dict[str | None, str]] = [{}]
    declared: dict[str | None, str] = {}
    out: dict[int, bytes] = {}
    depth, begin, inner, closed = 0, 0, 0, False

    def prefix(name: str | None, uri: str | None) -> None:
        if depth <= level:
            declared[name] = uri or ""

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal depth, declared, begin, inner, closed
        if depth <= level:
            e = Element(_name(tag), {_name(k): v for k, v in attrs.items()} if attrs else attrs)
            (stack[-1].children if stack else roots).append(e)
            stack.append(e)
            scopes.append(scopes[-1] | declared if depth < level else declared)
            declared = {}
            if depth == level:
                m = _TAG.match(data, p.CurrentByteIndex)
                begin, inner, closed = m.start(), m.end(), m[0].endswith(b"/>")
                p.CharacterDataHandler = None
        depth += 1

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1
        if depth > level:
            return
        e, own = stack.pop(), scopes.pop()
        if depth == level:
            body = data[begin : inner if closed else data.index(b">", p.CurrentByteIndex) + 1]
            around = [(n, u) for n, u in scopes[-1].items() if n not in own and (u if n is None else n.encode() + b":" in body)]
            if around:
                at = len(re.match(rb"<[^\s/>]+", body)[0])
                body = body[:at] + "".join(f' xmlns{f":{n}" if n else ""}="{escape(u)}"' for n, u in around).encode() + body[at:]
            out[id(e)] = body
            p.CharacterDataHandler = characters

    def characters(text: str) -> None:
        if stack[-1].children:
            stack[-1].children[-1].tail += text
        else:
            stack[-1].text += text

    def forbidden(*_: object) -> None:
        raise ValueError("a document type declaration is not allowed")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler, p.StartNamespaceDeclHandler = start, end, characters, forbidden, prefix
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed XML: {expat.ErrorString(e.code)}") from None
    return roots[0], out


def spans(data: bytes) -> list[Span]:
    """The elements of an XML part in document order, with the bytes they take up; ValueError for what is not UTF-8 or
    not well-formed. What is edited by these places keeps every other byte."""
    if not in_utf8(data):
        raise ValueError("only parts in UTF-8 are edited")
    out: list[Span] = []
    open_: list[Span] = []
    counts: list[int] = [0]
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True

    def start(tag: str, attrs: dict[str, str]) -> None:
        at = p.CurrentByteIndex
        m = _TAG.match(data, at)
        closed = m[0].endswith(b"/>")
        e = Span(len(out), len(out), open_[-1].first if open_ else None, len(open_), counts[-1], _name(tag), m[1].decode(), {_name(k): v for k, v in attrs.items()} if attrs else attrs, "", at, None if closed else m.end(), None, m.end())
        counts[-1] += 1
        out.append(e)
        open_.append(e)
        counts.append(0)

    def end(_: str) -> None:
        e = open_.pop()
        counts.pop()
        e.last = len(out) - 1
        if e.inner_start is not None:
            e.inner_end = p.CurrentByteIndex
            e.end = data.index(b">", e.inner_end) + 1

    def characters(text: str) -> None:
        open_[-1].text += text

    def forbidden(*_: object) -> None:
        raise ValueError("a document type declaration is not allowed")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = start, end, characters, forbidden
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed XML: {expat.ErrorString(e.code)}") from None
    return out


def escape(text: str) -> str:
    """text as it stands in a part; a carriage return as it is would be read as a line feed."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;")


_FORBIDDEN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def allowed(text: str) -> str:
    """text without the characters that XML 1.0 cannot hold (fixed values: its ranges)."""
    return _FORBIDDEN.sub("", text)
