"""Queries on links and pictures added, styles laid over, documents out of JSON, and the numbers of pages in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import edit, overlay, resources
from .operators.extract import Corpus
from .plans import resolve
from .queries import _LINE, _N, _corpus, _lines, _parts_of, _table, _texts, query
from .sources import from_json

_X = [{"t": "x"}]
_PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000280000001408060000")  # 40 by 20 pixels


def _first_paragraphs(c: Corpus):
    e = c.node_elements(styles=False).filter("role = 'main'")
    return e, e.filter("kind = 'Paragraph'").groupBy("doc_id", "part_name").agg(F.min("first").alias("paragraph"))


@query("""WITH p AS (SELECT page_id, coalesce(url, '') || CASE WHEN page_id % 3 = 0 THEN '?a=1&b="2"' ELSE '' END AS u FROM pages WHERE url IS NOT NULL)
SELECT page_id AS doc_id, 'old' AS text, 'http://old/' AS url, 2::BIGINT AS relations FROM p UNION ALL SELECT page_id, 'go <' || page_id || '>', u, 2 FROM p
UNION ALL SELECT page_id, 'again', u, 2 FROM p UNION ALL SELECT page_id, 'top', '#top', 2 FROM p UNION ALL SELECT page_id, 'same', 'http://old/', 2 FROM p""")
def added_links(spark, d):
    """Links put at the end of a paragraph: equal targets share a relationship, bookmarks need none, bad targets are refused."""
    pages = _table(spark, d, "pages").filter("url is not null").select(F.col("page_id").alias("doc_id"), F.concat("url", F.when(F.col("page_id") % 3 == 0, '?a=1&b="2"').otherwise("")).alias("url"))
    c = _corpus(pages, lambda row: {"blocks": [{"runs": [{"t": "old", "link": "http://old/"}]}]})
    e, at = _first_paragraphs(c)
    wanted = F.array(*[F.struct(F.lit(k).alias("seq"), t.alias("text"), u.alias("target")) for k, (t, u) in enumerate((
        (F.concat(F.lit("go <"), "doc_id", F.lit(">")), F.col("url")), (F.lit("again"), F.col("url")), (F.lit("top"), F.lit("#top")), (F.lit("same"), F.lit("http://old/")), (F.lit("bad"), F.lit("no address")), (F.lit("worse"), F.lit("http:///x"))))])
    requests = at.join(pages, "doc_id").select("doc_id", "part_name", "paragraph", F.inline(wanted))
    out = Corpus(edit.pack(resources.add_links(c.parts, e, c.relationships, requests)))
    n = out.relationships.filter("rel_type = 'hyperlink'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations"))
    return out.links().select("doc_id", "text", "url").join(n, "doc_id")


@query("SELECT page_id AS doc_id, 'see' AS text, CASE WHEN page_id % 2 = 0 THEN 'https://new/?q=1&r=2' || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END ELSE url END AS url FROM pages WHERE url IS NOT NULL")
def retargeted_links(spark, d):
    pages = _table(spark, d, "pages").filter("url is not null").select(F.col("page_id").alias("doc_id"), "url")
    c = _corpus(pages, lambda row: {"blocks": [{"runs": [{"t": "see", "link": row["url"]}]}]})
    r = c.relationships.filter("rel_type = 'hyperlink' and doc_id % 2 = 0")
    targets = r.select("doc_id", F.col("owner_part").alias("part_name"), "rid", F.lit("https://new/?q=1&r=2").alias("target"))
    return Corpus(edit.pack(resources.retarget_links(c.parts, c.relationships, targets))).links().select("doc_id", "text", "url")


@query(f"""SELECT doc_id, k::INT AS place, CASE WHEN k = 0 AND n % 2 = 0 THEN 'word/media/image2.png' WHEN k = 0 THEN 'word/media/image1.png' WHEN n % 2 = 0 THEN 'word/media/image1.png' ELSE 'word/media/image3.png' END AS target,
CASE k WHEN 0 THEN 30.0 ELSE 2.0 * (n % 5 + 1) END::DOUBLE AS width, CASE k WHEN 0 THEN 15.0 ELSE n % 5 + 1 END::DOUBLE AS height, 'about "' || k || '"' AS alternative_text FROM ({_N}), (SELECT unnest(range(2)) AS k)""")
def added_pictures(spark, d):
    """Two pictures for each package: of one that holds the first already it is used again; free names and ids are taken in order."""
    other = _PNG + b"2"

    def describe(n):
        return {"blocks": [{"runs": _X}], "media": {"image2.png": _PNG if n % 2 == 0 else b"other"}}

    c = _parts_of(spark, d, describe)
    e, at = _first_paragraphs(c)
    sizes = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 5 + 1).alias("h"))
    one = lambda k, content, height: F.struct(F.lit(k).alias("seq"), F.lit(content).alias("content"), F.lit(None).cast("double").alias("width"), height.cast("double").alias("height"), F.lit(f'about "{k}"').alias("alternative_text"))
    requests = at.join(sizes, "doc_id").select("doc_id", "part_name", "paragraph", F.inline(F.array(one(0, _PNG, F.lit(None)), one(1, other, F.col("h")), one(2, b"GIF89a", F.lit(1)))))
    out = Corpus(edit.pack(resources.add_pictures(c.parts, e, c.relationships, c.relationships.select("doc_id", F.lit(1).alias("id")).limit(0), requests)))
    rel = out.relationships.filter("rel_type = 'image'").select("doc_id", "rid", "target")


    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return out.drawings.join(rel, ["doc_id", "rid"]).select("doc_id", place.cast("int").alias("place"), "target", "width", "height", "alternative_text")


_STYLES = "SELECT doc_id, n, n % 3 AS r FROM (" + _N + ")"


@query(f"""WITH d AS ({_STYLES}) SELECT doc_id, 'Body' AS name, 'B' AS style_id, 'R' AS base_id, CASE r WHEN 0 THEN 10.0 ELSE 20.0 END::DOUBLE AS size, false AS is_default FROM d WHERE r < 2
UNION ALL SELECT doc_id, 'Root', 'R', NULL, 30.0, true FROM d WHERE r < 2
UNION ALL SELECT doc_id, 'Extra', CASE WHEN n % 2 = 0 THEN 'X_2' ELSE 'X' END, 'B', 40.0, false FROM d WHERE r < 2
UNION ALL SELECT doc_id, 'Mine', CASE WHEN n % 2 = 0 THEN 'X' ELSE 'Z' END, NULL, 5.0, false FROM d WHERE r < 2
UNION ALL SELECT doc_id, 'Root', 'R', NULL, 7.0, true FROM d WHERE r = 2 UNION ALL SELECT doc_id, 'Body', 'B', NULL, 6.0, false FROM d WHERE r = 2 UNION ALL SELECT doc_id, 'Mine', CASE WHEN n % 2 = 0 THEN 'X' ELSE 'Z' END, NULL, 5.0, false FROM d WHERE r = 2""")
def overlaid_styles(spark, d):
    """Of two references each name takes the document's id, an id that is taken gets a number; the third has another type
    of style under a name, so those documents stay."""
    def describe(n):
        return {"styles": [{"id": "R", "name": "Root", "default": True, "size": 7}, {"id": "B", "name": "Body", "size": 6}, {"id": "X" if n % 2 == 0 else "Z", "name": "Mine", "size": 5}], "blocks": [{"style": "B", "runs": _X}]}

    def reference(row):
        k = row["k"]
        return {"styles": [{"id": "q1", "name": "Body", "base": "q2", "size": 10 * k + 10, "kind": "character" if k == 2 else "paragraph"}, {"id": "q2", "name": "Root", "default": True, "size": 30}, {"id": "X", "name": "Extra", "base": "q1", "size": 40}], "blocks": [{"runs": _X}]}

    c = _parts_of(spark, d, describe)
    ref = _corpus(_table(spark, d, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("k")), reference)
    pairs = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 3).cast("long").alias("ref_id"))
    parts, _ = overlay.overlay_styles(c.parts, c.node_elements(), c.styles, (ref.parts, ref.node_elements(), ref.styles), pairs)
    return Corpus(edit.pack(parts)).styles.filter("style_id is not null").select("doc_id", "name", "style_id", "base_id", "size", "is_default")


@query(f"SELECT doc_id, true AS same, count(*)::BIGINT AS blocks, sum(length(line))::BIGINT AS chars FROM ({_LINE}) GROUP BY doc_id")
def json_roundtrip(spark, d):
    """Exported, imported and exported again: headings, lists, links, formats and tables are the same."""
    def describe(row):
        kinds = lambda k, x: [
            {"style": "Heading1", "runs": [{"t": x}]}, {"num": 1, "level": k % 2, "runs": [{"t": x[:2], "b": True, "size": 14}, {"t": x[2:], "i": True}]}, {"runs": [{"t": x, "link": "http://h/?a=1&b"}]},
            {"table": [[{"t": x, "span": 2}, {"t": ""}], [{"t": "", "vmerge": "restart"}, {"t": ""}, {"t": ""}]]}][k % 4]
        return {"blocks": [kinds(k, x) for k, x in enumerate(_lines(row))], "lists": [[{"fmt": "decimal", "text": f"%{k + 1}."} for k in range(9)]], "defaults": {"size": 10}}

    c = _corpus(_texts(spark, d), describe)
    first = c.settled(c.export(), "json")  # it is read twice
    again = Corpus(from_json.import_documents(first), dealt=c.dealt).export().withColumnRenamed("json", "again")
    body = "struct<rows: array<struct<cells: array<struct<text: string>>>>, text: string>"
    read = F.from_json("again", f"blocks array<{body}>")["blocks"]
    texts = F.transform(read, lambda b: F.coalesce(b["text"], F.get(F.get(b["rows"], F.lit(0))["cells"], F.lit(0))["text"]))
    return first.join(again, "doc_id").select("doc_id", (F.col("json") == F.col("again")).alias("same"), F.size(read).cast("long").alias("blocks"), F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("chars"))


@query("""SELECT p_partkey AS doc_id, ['invalid_json', 'unknown_version', 'unknown_block', 'unknown_field:colour', 'unknown_field:shape'][p_size % 6] AS fault FROM part WHERE p_size % 6 > 0""")
def json_faults(spark, d):
    good, run = '{"type": "paragraph", "text": "x", "runs": []}', '{"type": "paragraph", "text": "x", "runs": [{"text": "x", "shape": 1}]}'
    made = {0: f'{{"schema_version": 1, "blocks": [{good}]}}', 1: "[1, 2", 2: f'{{"schema_version": 2, "blocks": [{good}]}}', 3: '{"schema_version": 1, "blocks": [{"type": "sound"}]}', 4: '{"schema_version": 1, "blocks": [{"type": "paragraph", "colour": 1}]}', 5: f'{{"schema_version": 1, "blocks": [{run}]}}'}
    json = F.lit(made[0])
    for k, text in made.items():
        json = F.when(F.col("p_size") % 6 == k, text).otherwise(json)
    return from_json.faults(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), json.alias("json")))


@query(f"SELECT doc_id, CASE n % 4 WHEN 0 THEN 'page # of 9' WHEN 1 THEN 'page 7 of 9' WHEN 2 THEN 'page #' ELSE 'page # of #' END AS text FROM ({_N})")
def page_marks(spark, d):
    """The number of a page stays one through a package made from the text that was read."""
    def describe(n):
        field = lambda code, shown: {"field": code, "t": shown}
        runs = {0: [field(" PAGE ", "7"), {"t": " of 9"}], 1: [field(" PAGEREF x ", "7"), {"t": " of 9"}], 2: [field("PAGE \\* roman", "vii")], 3: [field("PAGE", "7"), {"t": " of "}, field(" page ", "8"), field("PAGE", "8")]}[n % 4]
        return {"blocks": [{"runs": [{"t": "page "}, *[r for r in runs if r.get("field") != " page "]]}]}

    first = resolve.page_marks(_parts_of(spark, d, describe).main)
    shown = first.filter("kind = 'Run'").withColumn("_code", F.col("text").rlike("^ ?PAGE")).filter("not _code")
    texts = shown.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("runs"))
    again = resolve.page_marks(_corpus(texts, lambda row: {"blocks": [{"runs": [{"t": t} for t in row["runs"]]}]}).main)
    kept = again.filter("kind = 'Run'").filter(~F.col("text").rlike("^ PAGE $"))
    out = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))
    return out.select("doc_id", F.replace("text", F.lit(resolve.PAGE), F.lit("#")).alias("text"))


@query("SELECT page_id AS doc_id, page_id % 5 IN (0, 4) AS allowed FROM pages")
def link_targets(spark, d):
    k = F.col("page_id") % 5
    target = F.when(k == 0, F.concat(F.lit("HTTPS://h/"), "page_id")).when(k == 1, "ftp://h/").when(k == 2, "mailto:").when(k == 3, "#").otherwise(F.concat(F.lit("mailto:"), "page_id", F.lit("@h")))
    return _table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), resources.link_fault(target).isNull().alias("allowed"))


@query("SELECT page_id, (page_id % 300 + 1)::INT AS width, 7::INT AS height, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS kind FROM pages")
def picture_headers(spark, d):
    """Sizes that picture headers hold, of both kinds, the frame of a JPEG behind another segment."""
    n = F.lpad(F.hex((F.col("page_id") % 300 + 1).cast("int")), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000"), n, F.lit("00000007080600"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC00011080007"), n, F.lit("030122"))
    content = F.unhex(F.when(F.col("page_id") % 2 == 0, png).otherwise(jpeg))
    size = F.coalesce(S.png_size(content), S.jpeg_size(content))
    return _table(spark, d, "pages").select("page_id", size["width"].alias("width"), size["height"].alias("height"), S.image_type(content).alias("kind"))


@query(f"""WITH d AS (SELECT doc_id, n FROM ({_N})) SELECT doc_id, 'footnote' AS kind, CASE WHEN n % 2 = 0 THEN '4' ELSE '1' END AS identifier, 'note ' || n AS text, NULL::VARCHAR AS parent_id, 0::BIGINT AS faults FROM d
UNION ALL SELECT doc_id, 'comment', CASE WHEN n % 2 = 0 THEN '6' ELSE '0' END, 'first ' || n, NULL, 0 FROM d WHERE n % 3 <> 2
UNION ALL SELECT doc_id, 'comment', CASE WHEN n % 2 = 0 THEN 6 + (n % 3 <> 2)::INT ELSE (n % 3 <> 2)::INT END::VARCHAR, 'answer', CASE WHEN n % 3 <> 2 THEN CASE WHEN n % 2 = 0 THEN '6' ELSE '0' END END, 0 FROM d
UNION ALL SELECT doc_id, 'footnote', '3', 'own', NULL, 0 FROM d WHERE n % 2 = 0 UNION ALL SELECT doc_id, 'comment', '5', 'own', NULL, 0 FROM d WHERE n % 2 = 0""")
def imported_annotations(spark, d):
    """Paragraphs with a note and a thread brought into packages with and without their own; an answer whose comment stays
    behind is a comment of its own."""
    from .operators import annotate
    from .plans import resolve as r

    def source(n):
        mark = lambda i: [{"raw": f'<w:commentRangeStart w:id="{i}"/>'}, *_X, {"raw": f'<w:commentRangeEnd w:id="{i}"/>'}, {"comment": i}]
        comments = [{"id": "7", "t": f"first {n}", "para_id": "00000031"}, {"id": "9", "t": "answer", "para_id": "00000032", "parent": "00000031", "done": "1"}]
        return {"styles": [{"id": "Normal", "name": "Normal", "default": True}, {"id": "S", "name": "Special", "base": "Normal", "size": 9}],
                "blocks": [{"style": "S", "runs": [*_X, {"note": 2}]}, {"runs": mark(7)}, {"runs": mark(9)}], "notes": [{"id": 2, "t": f"note {n}"}, {"id": 8, "t": "stays"}], "comments": comments}

    def target(n):
        own = {"notes": [{"id": 3, "t": "own"}], "comments": [{"id": "5", "t": "own", "para_id": "00000031"}]} if n % 2 == 0 else {}
        marks = [{"note": 3}, {"comment": 5}] if n % 2 == 0 else []
        return {"styles": [{"id": "Normal", "name": "Normal", "default": True}, {"id": "S", "name": "other"}], "blocks": [{"runs": [{"t": "body"}, *marks]}], **own}

    s, t = _parts_of(spark, d, source), _parts_of(spark, d, target)
    e = s.node_elements(styles=False).filter("role = 'main' and kind = 'Paragraph'")
    sizes = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n"))
    picked = e.join(sizes, "doc_id").filter("n % 3 <> 2 or place <> 1").select("doc_id", F.col("doc_id").alias("src_id"), "first", F.col("place").alias("seq"))
    out = Corpus(edit.pack(annotate.import_paragraphs(s, t, picked)))
    faults = out.annotation_faults().groupBy("doc_id").agg(F.count(F.lit(1)).alias("faults"))
    tree = r.comment_tree(out.stories, out.threads).select("doc_id", F.lit("comment").alias("kind"), F.col("comment_id").alias("identifier"), "parent_id")
    return out.stories.join(tree, ["doc_id", "kind", "identifier"], "left").join(faults, "doc_id", "left").select("doc_id", "kind", "identifier", "text", "parent_id", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@query(f"""SELECT doc_id, 'default header' AS kind, 'head ' || n AS text, 'header:default' AS type, NULL::INT AS uses FROM ({_N}) WHERE n % 2 = 0 UNION ALL SELECT doc_id, 'footnote', 'a' || n || chr(10) || 'B', 'normal', 2 FROM ({_N})
UNION ALL SELECT doc_id, 'comment', 'said' || chr(10) || 'in a cell', NULL, 0 FROM ({_N})""")
def exported_stories(spark, d):
    """Headers, notes and comments of the export, with the blocks in them: capitals by style, hidden runs left out, tables."""
    def describe(n):
        styles = [{"id": "Normal", "name": "Normal", "default": True}, {"id": "Gone", "name": "Gone", "kind": "character", "hidden": True}]
        notes = [{"id": 1, "t": f"a{n}", "more": [{"runs": [{"t": "b", "caps": True}, {"t": "left out", "rstyle": "Gone"}]}]}]
        comments = [{"id": 4, "t": "said", "more": [{"table": [[{"t": "in a cell"}]]}]}]
        head = {"stories": {"header1": f"head {n}"}, "sect": {"refs": [("header", "default", "header1")]}} if n % 2 == 0 else {}
        return {"styles": styles, "blocks": [{"runs": [*_X, {"note": 1}]}, {"runs": [{"note": 1}]}], "notes": notes, "comments": comments, **head}

    block = "array<struct<type: string, text: string>>"
    j = _parts_of(spark, d, describe).export().withColumn("e", F.from_json("json", f"headers_footers array<struct<type: string, blocks: {block}>>, source_stories array<struct<kind: string, note_type: string, references: int, blocks: {block}>>"))
    text = F.array_join("s.blocks.text", "\n")
    heads = j.select("doc_id", F.explode("e.headers_footers").alias("s")).select("doc_id", F.lit("default header").alias("kind"), text.alias("text"), F.col("s.type").alias("type"), F.lit(None).cast("int").alias("uses"))
    notes = j.select("doc_id", F.explode("e.source_stories").alias("s")).select("doc_id", "s.kind", text.alias("text"), F.col("s.note_type").alias("type"), F.col("s.references").alias("uses"))
    return heads.unionByName(notes)
