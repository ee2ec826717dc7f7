"""Word packages as rows: reading archives into parts, sniffing formats, and putting parts together again."""

from __future__ import annotations

import base64
import bisect
import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xml

# Limits on what is read.
INPUT_BYTES = PART_BYTES = 64 << 20
EXPANDED_BYTES = 256 << 20
ENTRIES = 10_000

MAIN = "word/document.xml"
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
WML = "application/vnd.openxmlformats-officedocument.wordprocessingml."
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
PARTS = "doc_id long, part_name string, ord int, content binary, load_error string, role string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Files under path as (path, doc_id, content); one over the limit is not opened, has no content and loads as an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= INPUT_BYTES).select("path", "content")
    large = files.filter(F.col("length") > INPUT_BYTES).select("path", F.lit(None).cast("binary").alias("content"))
    return small.union(large).select("path", F.xxhash64("path").alias("doc_id"), "content")


def sniff(content: Column) -> Column:
    """docx, doc or rtf by the first bytes, flat_opc by the root of the XML in any of its encodings; else null."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "ISO-8859-1"))
    root = r"(?s)^[^<]*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.\-]+:)?package\s[^>]*http://schemas\.microsoft\.com/office/2006/xmlPackage"
    return (
        F.when(head.startswith("504B0304"), "docx")
        .when(head == "D0CF11E0A1B11AE1", "doc")
        .when(head.startswith("7B5C727466"), "rtf")
        .when(text.rlike(root), "flat_opc")
    )


def part_key(name: str) -> str:
    """What tells parts apart, their decoded name whatever its case; ValueError for a name that could leave the package."""
    plain = unquote(name)
    if not plain or "\0" in plain or "\\" in plain or plain.startswith("/") or posixpath.normpath(plain) != plain or plain.startswith(".."):
        raise ValueError("an unsafe entry name")
    return plain.casefold()


def unzip(data: bytes) -> list[tuple[str, bytes]]:
    """The parts of an archive in its order; ValueError for what the limits or the names forbid."""
    if len(data) > INPUT_BYTES:
        raise ValueError("the input is too large")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError("not an archive") from None
    infos = z.infolist()
    if len(infos) > ENTRIES or sum(i.file_size for i in infos) > EXPANDED_BYTES:
        raise ValueError("the archive is too large")
    seen, out = set(), []
    ends = sorted([*(i.header_offset for i in infos), z.start_dir])
    for i in infos:
        if i.is_dir():
            continue
        key = part_key(i.filename)
        if key in seen or i.flag_bits & 1 or i.file_size > PART_BYTES:
            raise ValueError("a duplicate, encrypted or too large entry")
        seen.add(key)
        body = _inflated(data, i, ends[bisect.bisect_right(ends, i.header_offset)])
        if body is None:
            with z.open(i) as f:
                body = f.read(PART_BYTES + 1)
        if len(body) > PART_BYTES:
            raise ValueError("a too large entry")
        out.append((i.filename, body))
    return out


def _inflated(data: bytes, i: zipfile.ZipInfo, until: int) -> bytes | None:
    """The bytes of a plain deflated entry, inflated at once; null for one of another kind or with anything amiss, which is
    left to a reader of its own, as most of the time over small entries goes into making such readers."""
    at = i.header_offset
    if i.compress_type != zipfile.ZIP_DEFLATED or i.flag_bits or data[at : at + 4] != b"PK\x03\x04" or at + 30 > len(data):
        return None
    name, extra = struct.unpack_from("<HH", data, at + 26)
    begin = at + 30 + name + extra
    if data[at + 30 : at + 30 + name] != i.orig_filename.encode("cp437", "replace") or begin + i.compress_size > until:
        return None
    inflate = zlib.decompressobj(-15)
    try:
        body = inflate.decompress(data[begin : begin + i.compress_size], i.file_size + 1)
    except zlib.error:
        return None
    return body if inflate.eof and len(body) == i.file_size and zlib.crc32(body) == i.CRC else None


def _deflated(body: bytes) -> tuple[int, bytes]:
    """The checksum of a part, and its bytes compressed."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return zlib.crc32(body), deflate.compress(body) + deflate.flush()


_deflated_again = lru_cache(256)(_deflated)


def zip_parts(parts: list[tuple[str, bytes]]) -> bytes:
    """An archive of the parts, in their order and with fixed times, so that equal parts give equal bytes.

    Small parts that come again in package after package are compressed once."""
    out, listed, at = [], [], 0
    for name, body in parts:
        plain = name.isascii()
        coded = name.encode()
        crc, packed = (_deflated_again if len(body) <= xml.SMALL else _deflated)(body)
        # Version 2.0, names in UTF-8 where they need it, deflated, the first of January 1980, files of their owner.
        shared = struct.pack("<HHHHHIIIHH", 20, 0 if plain else 0x800, 8, 0, 33, crc, len(packed), len(body), len(coded), 0)
        listed.append(b"PK\x01\x02\x14\x03" + shared + struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at) + coded)
        out += [b"PK\x03\x04", shared, coded, packed]
        at += 30 + len(coded) + len(packed)
    if len(listed) > ENTRIES or at > INPUT_BYTES:
        return _zip_large(parts)
    directory = b"".join(listed)
    return b"".join([*out, directory, struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(listed), len(listed), len(directory), at, 0)])


def _zip_large(parts: list[tuple[str, bytes]]) -> bytes:
    """The same for what the plain form of archives may not hold."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, body in parts:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def content_type_of(name: str, types: xml.Element | None) -> str:
    if types is not None:
        for o in types.all(xml.TYPES + "Override"):
            if (o.get("PartName") or "").lstrip("/").lower() == name.lower():
                return o.get("ContentType") or ""
        for d in types.all(xml.TYPES + "Default"):
            if (d.get("Extension") or "").lower() == name.rpartition(".")[2].lower():
                return d.get("ContentType") or ""
    return "application/octet-stream"


def flat_encode(parts: list[tuple[str, bytes]]) -> bytes:
    """The parts as one XML package: XML parts inline, others in base64. The list of types becomes attributes."""
    by = dict(parts)
    types = xml.parse_again(by["[Content_Types].xml"]) if "[Content_Types].xml" in by else None
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><pkg:package xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage">']
    for name, body in parts:
        if name == "[Content_Types].xml":
            continue
        kind = content_type_of(name, types)
        head = f'<pkg:part pkg:name="/{xml.escape(name)}" pkg:contentType="{xml.escape(kind)}">'
        if name.endswith((".xml", ".rels")):
            text = body.decode("utf-8-sig")
            if text.startswith("<?xml"):
                text = text[text.index("?>") + 2 :].lstrip()
            out.append(f"{head}<pkg:xmlData>{text}</pkg:xmlData></pkg:part>")
        else:
            out.append(f"{head}<pkg:binaryData>{base64.b64encode(body).decode()}</pkg:binaryData></pkg:part>")
    return ("".join(out) + "</pkg:package>").encode()


def _serialised(e: xml.Element) -> str:
    def tag(name: str, spaces: dict[str, str]) -> str:
        if not name.startswith("{"):
            return name
        uri, local = name[1:].split("}")
        if uri == "http://www.w3.org/XML/1998/namespace":
            return f"xml:{local}"
        return f"{spaces.setdefault(uri, f'n{len(spaces)}')}:{local}"

    spaces: dict[str, str] = {}

    def node(x: xml.Element) -> str:
        name = tag(x.tag, spaces)
        attrs = "".join(f' {tag(k, spaces)}="{xml.escape(v)}"' for k, v in x.attrs.items())
        inner = xml.escape(x.text) + "".join(node(c) + xml.escape(c.tail) for c in x.children)
        return f"<{name}{attrs}>{inner}</{name}>" if inner else f"<{name}{attrs}/>"

    body = node(e)
    first = body.index("/>" if body.endswith("/>") and body.count("<") == 1 else ">")
    return '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body[:first] + "".join(f' xmlns:{p}="{u}"' for u, p in spaces.items()) + body[first:]


_DECLARATION = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def flat_decode(data: bytes) -> list[tuple[str, bytes]]:
    """The parts of an XML package, the list of types first; ValueError for unsafe names or broken payloads."""
    if len(data) > INPUT_BYTES:
        raise ValueError("the input is too large")
    # inline parts are the bytes that stand there, so that equal ones stay equal; only in another encoding are they written anew
    root, inside = xml.cut(data, 3) if xml.in_utf8(data) else (xml.parse(data), None)
    if root.tag != xml.PKG + "package":
        raise ValueError("not an XML package")
    out, overrides, seen, total = [], [], set(), 0
    for p in root.all(xml.PKG + "part"):
        name = (p.get(xml.PKG + "name") or "").lstrip("/")
        key = part_key(name)
        overrides.append((name, p.get(xml.PKG + "contentType") or ""))
        inline, binary = p.find(xml.PKG + "xmlData"), p.find(xml.PKG + "binaryData")
        if (inline is None) == (binary is None) or inline is not None and len(inline.children) != 1:
            raise ValueError("a part needs one payload")
        if binary is not None:
            try:
                body = base64.b64decode("".join(binary.text.split()), validate=True)
            except ValueError:
                raise ValueError("a part is not base64") from None
        else:
            payload = inline.children[0]
            body = _serialised(payload).encode() if inside is None else _DECLARATION + inside[id(payload)]
        total += len(body)
        if key in seen or len(body) > PART_BYTES or total > EXPANDED_BYTES or len(seen) >= ENTRIES:
            raise ValueError("a duplicate or too large part, or too many")
        seen.add(key)
        out.append((name, body))
    types = "".join(f'<Override PartName="/{xml.escape(n)}" ContentType="{xml.escape(t)}"/>' for n, t in overrides)
    return [("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{xml.TYPES[1:-1]}">{types}</Types>'.encode()), *out]


# The roles of parts by the last word of their relationship's type.
ROLES = ("styles", "settings", "numbering", "fontTable", "theme", "footnotes", "endnotes", "comments", "commentsExtended", "header", "footer")


def roles(parts_: list[tuple[str, bytes]]) -> dict[str, str]:
    """The role of parts: main, as the package's relationships say, and those that the main part's relationships name."""
    by = {part_key(n): (n, b) for n, b in parts_}

    def targets(owner: str) -> list[tuple[str, str]]:
        folder, _, base = owner.rpartition("/")
        found = by.get(part_key(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"))
        out = []
        try:
            for r in xml.parse_again(found[1]).all(xml.RELS + "Relationship") if found else ():
                if r.get("TargetMode") != "External":
                    out.append(((r.get("Type") or "").rpartition("/")[2], resolve_target(owner, r.get("Target") or "")))
        except ValueError:
            pass
        return out

    main = next((t for k, t in targets("") if k == "officeDocument" and t.casefold() in by), MAIN)
    out = {}
    if main.casefold() in by:
        main = by[main.casefold()][0]
        out[main] = "main"
        for kind, target in targets(main):
            if kind in ROLES and target.casefold() in by:
                out.setdefault(by[target.casefold()][0], kind)
    return out


def load(data: bytes) -> list[tuple[str, bytes]]:
    """Parts of a package in either form; ValueError for legacy formats and anything unknown."""
    if data[:4] == b"PK\x03\x04":
        return unzip(data)
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("a binary document: read it with sources.legacy")
    if data[:5] == b"{\\rtf":
        raise ValueError("rich text is not supported; convert it first")
    try:
        return flat_decode(data)
    except ValueError:
        raise ValueError("an unknown format") from None


def _explode(permissive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("part_name", pa.string()), ("ord", pa.int32()), ("content", pa.binary()), ("load_error", pa.string()), ("role", pa.string())])
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    opened = load(content.as_py() or b"")
                    role = roles(opened)
                    rows = [(doc_id, n, k, b, None, role.get(n)) for k, (n, b) in enumerate(opened)]
                except ValueError as e:
                    if not permissive:
                        raise
                    rows = [(doc_id, None, None, None, str(e), None)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return run


def parts(packages: DataFrame, permissive: bool = True) -> DataFrame:
    """(doc_id, part_name, ord, content, load_error, role, sha256) of packages (doc_id, content).

    A package that cannot be read gives one row with load_error, or fails the query unless permissive.
    """
    out = packages.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(_explode(permissive), PARTS)
    return out.withColumn("sha256", F.sha2("content", 256))


def recoded(packages: DataFrame, kind: str = "docx", permissive: bool = True) -> DataFrame:
    """packages (doc_id, content) in the form kind, docx or flat_opc, where they are: no rows of parts are made or moved.

    A package that cannot be read stays as it is, or fails the query unless permissive.
    """
    encode = flat_encode if kind == "flat_opc" else zip_parts

    def one(content: bytes | None) -> bytes | None:
        try:
            return encode(load(content or b""))
        except ValueError:
            if not permissive:
                raise
            return content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                yield pa.record_batch([b.column(0), pa.array([one(c.as_py()) for c in b.column(1)], pa.binary())], ["doc_id", "content"])

    return packages.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, content binary")


def resolve_target(owner: str, target: str) -> str:
    """The part that a relationship of part owner points to; ValueError for one outside the package."""
    path = unquote(target)
    full = posixpath.normpath(path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(owner), path))
    if full.startswith("..") or full.startswith("/"):
        raise ValueError("a target outside the package")
    return full


def _packer(kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        made = list(zip(table.column("part_name").to_pylist(), (x.as_py() for x in table.column("content")), strict=True))
        return pa.table({"doc_id": table.column("doc_id")[:1], "content": pa.array([flat_encode(made) if kind == "flat_opc" else zip_parts(made)], pa.binary())})

    return run


def pack(parts_: DataFrame, kind: str = "docx") -> DataFrame:
    """(doc_id, content): the parts (doc_id, part_name, ord, content) of each document as one package."""
    return parts_.filter("part_name is not null").select("doc_id", "part_name", "ord", "content").groupBy("doc_id").applyInArrow(_packer(kind), "doc_id long, content binary")
