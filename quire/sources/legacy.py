"""Binary documents (97-2003): the compound file, the file information block and the piece table, down to body text.

A small writer makes such files from text, for round trips.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Offsets and marks of the formats.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
WORD_IDENT, TABLE_FLAG, CCP_TEXT, FC_CLX = 0xA5EC, 0x0200, 0x4C, 0x01A2


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name; ValueError for broken chains."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    size, mini = 1 << struct.unpack_from("<H", data, 0x1E)[0], 1 << struct.unpack_from("<H", data, 0x20)[0]
    start, = struct.unpack_from("<I", data, 0x30)
    cutoff, mini_start, _, difat, more = struct.unpack_from("<IIIII", data, 0x38)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    places = list(struct.unpack_from("<109I", data, 0x4C))
    while more and difat not in (END, FREE):
        block = struct.unpack(f"<{size // 4}I", sector(difat))
        places += block[:-1]
        difat, more = block[-1], more - 1
    fat: list[int] = []
    for k in places:
        if k not in (FREE, END):
            raw = sector(k)
            fat += struct.unpack(f"<{len(raw) // 4}I", raw)

    def chain(k: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while k != END:
            if k >= len(table) or seen > len(table):
                raise ValueError("a broken chain")
            yield k
            k, seen = table[k], seen + 1

    read = lambda k: b"".join(map(sector, chain(k, fat)))
    directory = read(start)
    mini_fat = list(struct.unpack(f"<{len(m) // 4}I", m)) if mini_start != END and (m := read(mini_start)) else []
    entries = [directory[k : k + 128] for k in range(0, len(directory), 128)]
    root = next((e for e in entries if e[66] == 5), None)
    if root is None:
        raise ValueError("no root entry")
    small = read(struct.unpack_from("<I", root, 116)[0]) if mini_fat else b""
    out = {}
    for e in entries:
        if e[66] == 2:
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le")
            first, length = struct.unpack_from("<II", e, 116)
            body = b"" if not length else b"".join(small[k * mini : (k + 1) * mini] for k in chain(first, mini_fat)) if length < cutoff else read(first)
            out[name] = body[:length]
    return out


def piece_text(word: bytes, table: bytes) -> str:
    """The characters of all pieces, in order of position: 1252 bytes or UTF-16 by each piece's flag."""
    at, length = struct.unpack_from("<II", word, FC_CLX)
    clx, k = table[at : at + length], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        raise ValueError("no piece table")
    size, = struct.unpack_from("<I", clx, k + 1)
    plc = clx[k + 5 : k + 5 + size]
    n = (size - 4) // 12
    cps = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for i in range(n):
        fc, = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
        count = cps[i + 1] - cps[i]
        if fc & 0x40000000:
            first = (fc & 0x3FFFFFFF) // 2
            out.append(word[first : first + count].decode("cp1252", "replace"))
        else:
            out.append(word[fc : fc + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)


def evaluate_fields(text: str) -> str:
    """text with each field (codes 19, 20, 21) replaced by its result; the unmatched rest of a field is left out."""
    stack: list[list] = [[[], True]]
    for c in text:
        if c == "\x13":
            stack.append([[], False])
        elif c == "\x14" and len(stack) > 1:
            stack[-1] = [[], True]
        elif c == "\x15" and len(stack) > 1:
            inner, shown = stack.pop()
            if shown:
                stack[-1][0] += inner
        elif c not in "\x14\x15":
            stack[-1][0].append(c)
    return "".join(stack[0][0])


def paragraphs(data: bytes) -> list[tuple[str, bool]]:
    """(text, in a table) of the body's paragraphs: cells end at \\x07, page breaks begin a paragraph of their own."""
    parts = streams(data)
    word = parts.get("WordDocument", b"")
    if len(word) < FC_CLX + 8 or struct.unpack_from("<H", word)[0] != WORD_IDENT:
        raise ValueError("not a binary Word document")
    flags, = struct.unpack_from("<H", word, 0x0A)
    if flags & 0x0100:
        raise ValueError("an encrypted document")
    table = parts.get("1Table" if flags & TABLE_FLAG else "0Table")
    if table is None:
        raise ValueError("no table stream")
    # positions count UTF-16 units
    units = piece_text(word, table).encode("utf-16-le", "surrogatepass")
    body = evaluate_fields(units[: 2 * struct.unpack_from("<I", word, CCP_TEXT)[0]].decode("utf-16-le", "replace"))
    out, held = [], []
    for c in body:
        if c in "\r\x07":
            out.append(("".join(held), c == "\x07"))
            held = []
        elif c == "\f":
            out += [("".join(held), False)] if held else []
            out.append(("\f", False))
            held = []
        elif c not in "\x01\x02\x05\x08":
            held.append("\n" if c == "\v" else c)
    return [*out, ("".join(held), False)] if held else out


def build(text: str, piece: int = 1000) -> bytes:
    """A binary document of the lines of text; pieces that 1252 can hold are stored in one byte a character."""
    body = text.replace("\n", "\r") + "\r"
    units = body.encode("utf-16-le")
    total = len(units) // 2
    word, cps, pcds = bytearray(1536), [0], []
    k = 0
    while k < total:
        n = min(piece, total - k)
        if n < total - k and 0xD8 <= units[2 * (k + n) - 1] < 0xDC:
            n += 1
        chunk = units[2 * k : 2 * (k + n)].decode("utf-16-le")
        try:
            raw = chunk.encode("cp1252")
            if len(raw) != n:
                raise ValueError
            pcds.append(struct.pack("<HIH", 0, 0x40000000 | 2 * len(word), 0))
        except ValueError:
            word += b"\0" * (len(word) % 2)
            raw = units[2 * k : 2 * (k + n)]
            pcds.append(struct.pack("<HIH", 0, len(word), 0))
        word += raw
        k += n
        cps.append(k)
    plc = struct.pack(f"<{len(cps)}I", *cps) + b"".join(pcds)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<HHHHHH", word, 0, WORD_IDENT, 0xC1, 0, 0x409, 0, TABLE_FLAG)
    struct.pack_into("<I", word, CCP_TEXT, total)
    struct.pack_into("<II", word, FC_CLX, 0, len(clx))
    return compound({"WordDocument": bytes(word).ljust(4096, b"\0"), "1Table": clx.ljust(4096, b"\0")})


def compound(parts: dict[str, bytes]) -> bytes:
    """A compound file of streams of at least 4096 bytes, in sectors of 512."""
    need = lambda n: -(-n // 512)
    entries = 1 + len(parts)
    directory = need(128 * entries)
    total = directory + sum(need(len(b)) for b in parts.values())
    fats = 1
    while need(4 * (total + fats)) > fats:
        fats += 1
    if fats > 109:
        raise ValueError("too large")
    fat, sectors, at = [FAT_SECTOR] * fats, [], fats

    def run(n: int) -> int:
        nonlocal at
        first = at
        fat.extend([*range(at + 1, at + n), END])
        at += n
        return first

    run(directory)
    names = [struct.pack("<64sHBBIII36sIII", "Root Entry".encode("utf-16-le"), 22, 5, 1, FREE, FREE, 1, b"", END, 0, 0)]
    for k, (name, body) in enumerate(parts.items()):
        first = run(need(len(body)))
        right = k + 2 if k + 1 < len(parts) else FREE
        names.append(struct.pack("<64sHBBIII36sIII", name.encode("utf-16-le"), 2 * len(name) + 2, 2, 1, FREE, right, FREE, b"", first, len(body), 0))
        sectors.append(body.ljust(512 * need(len(body)), b"\0"))
    fat += [FREE] * (fats * 128 - len(fat))
    head = struct.pack("<8s16sHHHHH6sIIIIIIIIII", MAGIC, b"", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, fats, fats, 0, 4096, END, 0, END, 0, 0)[:76]
    head += struct.pack("<109I", *range(fats), *[FREE] * (109 - fats))
    return head + struct.pack(f"<{len(fat)}I", *fat) + b"".join(names).ljust(512 * directory, b"\0") + b"".join(sectors)


def doc_paragraphs(packages: DataFrame) -> DataFrame:
    """(doc_id, place, text, in_table, load_error) of binary documents (doc_id, content); a broken one is one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows += [(doc_id, k, t, c, None) for k, (t, c) in enumerate(paragraphs(content.as_py() or b""))]
                except (ValueError, struct.error) as e:
                    rows.append((doc_id, None, None, None, str(e) or "broken"))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()))], ["doc_id", "place", "text", "in_table", "load_error"])

    return packages.select("doc_id", "content").mapInArrow(run, "doc_id long, place int, text string, in_table boolean, load_error string")
