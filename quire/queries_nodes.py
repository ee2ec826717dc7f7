"""Queries on trees of nodes, on the marks and dates of annotations, and on edits of nodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import edit, splice
from .operators.extract import Corpus
from .plans import annotations, tree
from .queries import _LINE, _N, _conversation, _corpus, _lines, _parts_of, _plain, _table, _texts, query

_X = [{"t": "x"}]


# ------------------------------------------------------------------------------------------------ trees
def _nested(n: int) -> dict:
    """n % 3 tables, each inside a cell of the one before, all with two cells; then a paragraph with a link."""
    inner = [{"runs": [{"t": f"deep{n}"}]}]
    for k in range(n % 3):
        inner = [{"table": [[{"blocks": [*inner, {"runs": [{"t": f"c{k}"}]}]}, {"t": "d"}]]}]
    return {"blocks": [*inner, {"runs": [{"t": "see "}, {"t": "page", "link": "http://h"}]}]}


@query(f"""SELECT doc_id, d * 2 + 2 + CASE WHEN d > 0 THEN 0 ELSE 0 END AS paragraphs, d AS tables, d AS rows, d * 2 AS cells, d * 2 + 3 AS runs FROM (SELECT doc_id, (n % 3)::BIGINT AS d FROM ({_N}))""")
def subtree_counts(spark, d):
    c = _parts_of(spark, d, _nested)
    counts = tree.subtree_counts(c.node_elements(styles=False), ("Paragraph", "Table", "Row", "Cell", "Run")).filter("kind = 'Body'")
    return counts.select("doc_id", F.col("Paragraph").alias("paragraphs"), F.col("Table").alias("tables"), F.col("Row").alias("rows"), F.col("Cell").alias("cells"), F.col("Run").alias("runs"))


@query(f"""WITH t AS (SELECT doc_id, n, unnest(range(n % 3)) AS k FROM ({_N}))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k DESC))::INT AS place, 'deep' || n || string_agg('c' || k || 'd', '') OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS text FROM t""")
def table_descendants(spark, d):
    """The text below each table, tables inside it included; outer tables come first."""
    e = _parts_of(spark, d, _nested).node_elements(styles=False)
    tables = e.filter("kind = 'Table'")
    place = tree.ancestors(e, tables, "Table").groupBy("doc_id", "node").agg(F.max("up").alias("place"))
    t = tree.texts(e, tables).join(place, ["doc_id", "node"], "left")
    return t.select("doc_id", (F.coalesce("place", F.lit(0)) + 1).alias("place"), "text")


@query(f"SELECT doc_id, kind, k::INT AS place FROM ({_N}), (SELECT unnest(['Run', 'Hyperlink']) AS kind, 0 AS k)")
def child_nodes(spark, d):
    """Direct children of the last paragraph: a run and a link, whose own run is no child of the paragraph."""
    e = _parts_of(spark, d, _nested).node_elements(styles=False)
    last = e.filter("kind = 'Paragraph'").groupBy("doc_id").agg(F.max("first").alias("node"))
    pairs = tree.children(e, "Run").unionByName(tree.children(e, "Hyperlink"))
    return pairs.join(last, ["doc_id", "node"], "left_semi").select("doc_id", "kind", F.col("place_in_kind").alias("place"))


# ------------------------------------------------------------------------------------------------ annotations
def _marked(*marks: tuple[str, int]) -> list[dict]:
    tags = {"start": "commentRangeStart", "end": "commentRangeEnd"}
    return [{"raw": f'<w:{tags[k]} w:id="{i}"/>'} if k in tags else {"comment": i} if k == "reference" else {"raw": "<w:r><w:annotationRef/></w:r>"} for k, i in marks]


@query(f"""SELECT doc_id, CASE n % 8 WHEN 7 THEN NULL ELSE '1' END AS identifier, ['duplicate_anchor', 'incomplete_range', 'reversed_range', 'missing_story', 'duplicate_story', 'nested_reply', 'anchor_inside', 'annotation_outside'][n % 8 + 1] AS fault FROM ({_N})""")
def comment_faults(spark, d):
    def describe(n):
        whole = [("start", 1), ("end", 1), ("reference", 1)]
        marks = {0: [*whole, ("reference", 1)], 1: [("start", 1), ("reference", 1)], 2: [("end", 1), ("start", 1), ("reference", 1)], 7: [*whole, ("annotation", 0)]}.get(n % 8, whole)
        comments = [{"id": "1", "t": "x", "para_id": "00000011"}]
        if n % 8 == 3:
            comments = [{"id": "2", "t": "x"}]
        if n % 8 == 4:
            comments = [{"id": "1", "t": "x"}, {"id": " +1", "t": "y"}]
        if n % 8 == 5:
            comments = [{"id": "1", "t": "x", "para_id": "00000011", "parent": "00000012"}, {"id": "2", "t": "y", "para_id": "00000012", "parent": "00000013"}, {"id": "3", "t": "z", "para_id": "00000013"}]
        if n % 8 == 6:
            comments = [{"id": "1", "t": "x", "runs": _marked(("start", 9))}]
        return {"blocks": [{"runs": [*_X, *_marked(*marks)]}], "comments": comments}

    return _parts_of(spark, d, describe).annotation_faults()


@query(f"SELECT doc_id, CASE n % 3 WHEN 0 THEN 'footnoteReference' WHEN 1 THEN 'start' ELSE 'separator' END AS kind, CASE n % 3 WHEN 0 THEN n::VARCHAR WHEN 1 THEN '7' END AS identifier, CASE n % 3 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS missing FROM ({_N})")
def unreached_marks(spark, d):
    """Marks where reading does not come, beside equal ones where it does: each is missing as often as it stands there."""
    def describe(n):
        mark = {0: f'<w:footnoteReference w:id="{n}"/>', 1: '<w:commentRangeStart w:id="+7"/>', 2: "<w:separator/>"}[n % 3]
        outer = '<w:commentRangeStart w:id="7"/>' if n % 3 == 1 else f"<w:r>{mark}</w:r>"
        hidden = f"<w:object><w:p><w:r>{mark if n % 3 != 1 else ''}</w:r>{mark if n % 3 == 1 else ''}</w:p></w:object>" * (2 if n % 3 == 2 else 1)
        return {"blocks": [{"runs": [*_X, {"raw": outer}, {"raw": f"<w:r>{hidden}</w:r>"}]}]}

    return annotations.unreached_marks(_parts_of(spark, d, describe).annotation_marks)


@query(f"SELECT doc_id, '1' AS identifier, '2' AS other FROM ({_N}) WHERE n % 3 = 0")
def crossed_ranges(spark, d):
    def describe(n):
        order = {0: "s1 s2 e1 e2", 1: "s1 s2 e2 e1", 2: "s1 e1 s2 e2"}[n % 3].split()
        marks = [({"s": "start", "e": "end"}[x[0]], int(x[1])) for x in order]
        return {"blocks": [{"runs": [r for m in marks for r in (*_marked(m), *_X)]}]}

    return annotations.crossed_ranges(_parts_of(spark, d, describe).annotation_marks)


_ID_SPACE = 'xmlns:m="http://schemas.microsoft.com/office/word/2016/wordml/cid"'
_EXT_SPACE = 'xmlns:m="http://schemas.microsoft.com/office/word/2018/wordml/cex"'


@query(f"""SELECT doc_id, '1' AS comment_id, n % 4 < 2 AS modern, CASE n % 4 WHEN 0 THEN TIMESTAMP '2024-05-01 08:30:00' + to_minutes(n) WHEN 1 THEN TIMESTAMP '2024-05-01 10:30:00' WHEN 2 THEN TIMESTAMP '2024-07-01 10:00:00'
ELSE NULL END AS date_utc FROM ({_N})""")
def comment_utc_dates(spark, d):
    """Through paragraph and durable ids to the last record; else the comment's own reading, of a zone that is named."""
    def describe(n):
        own = {2: "2024-07-01T12:00:00Z"}.get(n % 4, "2024-13-01T00:00:00")
        ids = f'<m:commentId m:paraId="00000011" m:durableId="0000000F"/><m:commentId m:paraId="00000011" m:durableId="{"A" if n % 4 < 2 else "ABC"}"/>'
        date = f"2024-05-01T{(510 + n) // 60:02d}:{(510 + n) % 60:02d}:00Z" if n % 4 == 0 else "2024-05-01T12:30:00+02:00"
        ext = '<m:commentExtensible m:durableId="0000000A" m:dateUtc="1999-01-01T00:00:00Z"/>' + f'<m:commentExtensible m:durableId="0000000A" m:dateUtc="{date}"/>'
        raw = {"commentsIds": f"<m:commentsIds {_ID_SPACE}>{ids}</m:commentsIds>", "commentsExtensible": f"<m:commentsExtensible {_EXT_SPACE}>{ext}</m:commentsExtensible>"}
        types = {"commentsIds": "http://schemas.microsoft.com/office/2016/09/relationships/commentsIds", "commentsExtensible": "http://schemas.microsoft.com/office/2018/08/relationships/commentsExtensible"}
        return {"blocks": [{"runs": [{"comment": 1}]}], "comments": [{"id": "1", "t": "x", "para_id": "00000011", "date": own}], "raw_parts": raw, "rel_types": types}

    return _parts_of(spark, d, describe).comment_dates("Europe/Berlin").select("doc_id", "comment_id", "date_utc", "modern")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN TIMESTAMP '2024-02-29 01:02:03.123456' WHEN 1 THEN TIMESTAMP '2024-02-29 00:00:00' WHEN 2 THEN TIMESTAMP '2024-02-29 23:59:59' WHEN 3 THEN TIMESTAMP '2024-02-29 01:02:03' END AS wall,
CASE p_size % 6 WHEN 0 THEN 0 WHEN 3 THEN -(p_size % 14) * 60 - 30 END::INT AS zone FROM part""")
def comment_date_forms(spark, d):
    n = F.col("p_size")
    raw = (
        F.when(n % 6 == 0, " 2024-02-29T01:02:03.12345678Z ").when(n % 6 == 1, "2024-02-29").when(n % 6 == 2, "2024-02-29 23:59:59")
        .when(n % 6 == 3, F.concat(F.lit("2024-02-29t01:02:03-"), n % 14, F.lit(":30"))).when(n % 6 == 4, "2023-02-29T00:00:00").otherwise("2024-02-29T01:02:03+14:01"))
    return _table(spark, d, "part").select("p_partkey", annotations.parsed_date(raw).alias("p")).select("p_partkey", "p.wall", "p.zone")


# ------------------------------------------------------------------------------------------------ edits
def _read_back(parts):
    return Corpus(edit.pack(parts))


def _lines_of(c: Corpus):
    """Elements of the main story, its paragraphs with their place among the body's elements."""
    e = c.node_elements(styles=False).filter("role = 'main'")
    return e, e.filter("kind = 'Paragraph'")


@query(f"""WITH l AS (SELECT doc_id, i, line FROM ({_LINE})), e AS (SELECT doc_id, i, 0 AS k, 'new' || i AS line FROM l WHERE i % 4 = 0 UNION ALL SELECT doc_id, i, 1, line FROM l WHERE i % 3 <> 1 UNION ALL SELECT doc_id, i, 2, line FROM l WHERE i % 3 = 2
UNION ALL SELECT doc_id, 1000000, 3, 'end' FROM documents)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i, k) AS text FROM e WHERE line <> '' GROUP BY doc_id""")
def edited_paragraphs(spark, d):
    """Paragraphs inserted, removed, copied and appended in one plan, for all documents."""
    c = _corpus(_texts(spark, d), _plain).keep_parts()
    e, p = _lines_of(c)
    parts, i = c.parts, F.col("place")
    new = lambda t: F.concat(F.lit("<w:p><w:r><w:t>"), splice.escaped(t), F.lit("</w:t></w:r></w:p>"))
    edits = splice.insert_before(p.filter(i % 4 == 0), new(F.concat(F.lit("new"), i)))
    edits = edits.unionByName(splice.remove(p.filter(i % 3 == 1))).unionByName(splice.clone(p.filter(i % 3 == 2), parts))
    edits = edits.unionByName(splice.append_to_body(e.filter("kind = 'Body'"), e, F.lit("<w:p><w:r><w:t>end</w:t></w:r></w:p>")))
    return _read_back(splice.apply(parts, edits)).text()


@query(f"""SELECT doc_id, i::INT AS place, k::INT AS run, CASE k WHEN 0 THEN line[1:3] WHEN 1 THEN line[4:5] ELSE line[6:] END AS text FROM ({_LINE}), (SELECT unnest(range(3)) AS k)
WHERE (k = 0 AND line <> '') OR (k = 1 AND length(line) > 3) OR (k = 2 AND length(line) > 5)""")
def split_runs(spark, d):
    """Every run split behind its third and fifth code point; the parts keep its formatting and its text."""
    c = _corpus(_texts(spark, d), lambda row: {"blocks": [{"runs": [{"t": x, "b": True}]} for x in _lines(row)]}).keep_parts()
    e, _ = _lines_of(c)
    runs = e.filter("kind = 'Run'").select("doc_id", "part_name", F.col("first").alias("run"), F.explode(F.array(F.lit(3), F.lit(5))).alias("offset"))
    out = _read_back(splice.apply(c.parts, splice.split_runs(e, c.parts, runs))).shred("inlines")
    return out.inlines.filter("kind = 'Run' and b and text <> ''").select("doc_id", F.element_at("block_path", 1).alias("place"), F.col("ord").alias("run"), "text")


@query(f"SELECT doc_id, coalesce(string_agg(CASE WHEN length(line) >= 6 THEN line[1:2] || '<&>' || line[5:] || '!' ELSE line END, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text FROM ({_LINE}) GROUP BY doc_id")
def replaced_ranges(spark, d):
    """A range over three runs replaced, and text put in at a paragraph's end."""
    def describe(row):
        return {"blocks": [{"runs": [{"t": x[:3]}, {"t": x[3:4], "i": True}, {"t": x[4:]}]} for x in _lines(row)]}

    c = _corpus(_texts(spark, d), describe)
    e, _ = _lines_of(c)
    long_ = splice.run_texts(e).groupBy("doc_id", "part_name", "paragraph").agg(F.sum("size").cast("int").alias("n")).filter("n >= 6")
    one = lambda a, b, new: long_.select("doc_id", "part_name", "paragraph", a.alias("begin"), b.alias("stop"), F.lit(new).alias("new"))
    ranges = one(F.lit(2), F.lit(4), "<&>").unionByName(one(F.col("n"), F.col("n"), "!"))
    return _read_back(splice.apply(c.parts, splice.replace_ranges(e, ranges))).text()


@query("""SELECT conv_id AS doc_id, turn::INT AS place, CASE WHEN role = 'user' THEN 'a cell ends with a paragraph' ELSE NULL END AS refused FROM conversations WHERE conv_id IS NOT NULL""")
def refused_removals(spark, d):
    """The only paragraph of a cell may not go; one of two may."""
    def describe(row):
        return {"blocks": [{"table": [[{"blocks": [{"runs": _X}] * (1 if t["role"] == "user" else 2)}]]} for t in row["turns"]]}

    c = _corpus(_conversation(spark, d), describe)
    e = c.node_elements(styles=False).filter("role = 'main'")
    cells = e.filter("kind = 'Cell'").select("doc_id", "part_name", F.col("first").alias("parent"))
    target = e.filter("kind = 'Paragraph'").join(cells, ["doc_id", "part_name", "parent"], "left_semi")
    last = target.groupBy("doc_id", "part_name", "parent").agg(F.max("first").alias("first"))
    target = target.join(last, ["doc_id", "part_name", "parent", "first"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return splice.removable(target, e).select("doc_id", place.cast("int").alias("place"), "refused")
