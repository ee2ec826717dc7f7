"""Queries over the driver's tables: packages are made from rows, read back, and the answer is compared with SQL on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import links
from .functions import scalars as S
from .operators import edit, pdf
from .operators.extract import Corpus
from .plans import cascade, identity, properties, resolve
from .sources import legacy, package
from .sources.builder import make_packages, tasks_for
from .store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text", "lang")


def _lines(row: dict) -> list[str]:
    return (row["text"] or "").split("\n")


def _corpus(df: DataFrame, describe) -> Corpus:
    tasks = tasks_for(df)
    return Corpus(make_packages(df, describe, tasks), dealt=tasks)


def _plain(row: dict) -> dict:
    return {"blocks": [{"runs": [{"t": x}]} for x in _lines(row)]}


_LINE = "SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents"


_TEXT = "SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text FROM (" + _LINE + ") GROUP BY doc_id"


@query(_TEXT)
def plain_text(spark, d):
    return _corpus(_texts(spark, d), _plain).text()


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS paragraphs FROM documents")
def paragraph_count(spark, d):
    return _corpus(_texts(spark, d), _plain).shred("blocks").blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))


@query(f"""SELECT doc_id, i::INT AS place, CASE WHEN i = 0 THEN 1 ELSE 2 END::INT AS heading_level, CASE WHEN i = 0 THEN 1 ELSE 2 END::INT AS depth, line AS text
FROM ({_LINE}) WHERE i = 0 OR i % 5 = 4""")
def heading_outline(spark, d):
    def describe(row):
        return {"blocks": [{"style": "Heading1" if k == 0 else "Heading2" if k % 5 == 4 else None, "runs": [{"t": x}]} for k, x in enumerate(_lines(row))]}

    h = _corpus(_texts(spark, d), describe).headings()
    return h.select("doc_id", F.element_at("path", 1).alias("place"), "heading_level", "depth", "text")


@query(f"SELECT doc_id, i::INT AS place, [1, 3, 2, 3][i % 4 + 1]::INT AS heading_level, [1, 2, 2, 3][i % 4 + 1]::INT AS depth FROM ({_LINE})")
def outline_depth(spark, d):
    def describe(row):
        return {"blocks": [{"outline": (0, 2, 1, 2)[k % 4], "runs": [{"t": x}]} for k, x in enumerate(_lines(row))]}

    return _corpus(_texts(spark, d), describe).headings().select("doc_id", F.element_at("path", 1).alias("place"), "heading_level", "depth")


@query(f"SELECT doc_id, sum(CASE WHEN i % 2 = 1 THEN length(line) ELSE 0 END)::BIGINT AS bold_chars, sum(length(line))::BIGINT AS chars FROM ({_LINE}) GROUP BY doc_id HAVING sum(length(line)) > 0")
def bold_char_share(spark, d):
    def describe(row):
        return {"blocks": [{"runs": [{"t": x, "b": True if k % 2 else None}]} for k, x in enumerate(_lines(row))]}

    runs = _corpus(_texts(spark, d), describe).fonts("b")
    return runs.groupBy("doc_id").agg(F.sum(F.when(F.col("b"), F.length("text")).otherwise(0)).cast("long").alias("bold_chars"), F.sum(F.length("text")).cast("long").alias("chars"))


_PART = "SELECT p_partkey AS doc_id, p_size % 2 = 1 AS pb, p_size % 3 = 0 AS cb, CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 7 = 0 THEN false END AS rb, p_size FROM part"


def _styled(row: dict) -> dict:
    n = row["p_size"]
    styles = [
        {"id": "Normal", "name": "Normal", "default": True},
        {"id": "Base", "name": "Base", "base": "Normal", "b": True if n % 2 else None, "size": 12 if n % 4 == 0 else None},
        {"id": "Para", "name": "Para", "base": "Base", "i": True},
        {"id": "Char", "name": "Char", "kind": "character", "b": True if n % 3 == 0 else None, "size": 14 if n % 10 == 0 else None},
    ]
    direct = True if n % 5 == 0 else False if n % 7 == 0 else None
    runs = [{"t": "x", "rstyle": "Char", "b": direct, "size": 20 if n % 11 == 0 else None}]
    return {"styles": styles, "defaults": {"b": True if n % 13 == 0 else None, "size": 9 if n % 6 == 0 else None}, "blocks": [{"style": "Para", "runs": runs}]}


@query(f"""SELECT doc_id, coalesce(rb, CASE WHEN pb AND cb THEN p_size % 13 = 0 OR false WHEN cb THEN true WHEN pb THEN true ELSE p_size % 13 = 0 END) AS bold, true AS italic,
CASE WHEN p_size % 11 = 0 THEN 20 WHEN p_size % 10 = 0 THEN 14 WHEN p_size % 4 = 0 THEN 12 WHEN p_size % 6 = 0 THEN 9 ELSE 10 END::DOUBLE AS size FROM ({_PART})""")
def effective_font(spark, d):
    runs = _corpus(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size"), _styled).fonts("b", "i", "size")
    return runs.select("doc_id", F.col("b").alias("bold"), F.col("i").alias("italic"), "size")


@query("SELECT p_partkey AS doc_id, (p_size % 6)::INT AS depth FROM part")
def style_chain_depth(spark, d):
    def describe(row):
        n = row["p_size"] % 6
        return {"styles": [{"id": f"S{k}", "name": f"S{k}", "base": f"S{k - 1}" if k else "S5" if n == 5 else None} for k in range(6)], "blocks": [{"style": f"S{n}"}]}

    c = _corpus(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size"), describe).shred("styles", "blocks")
    depth = resolve.style_layers(c.styles).groupBy("doc_id", "style_id").agg(F.max("depth").alias("depth"))
    return c.blocks.join(depth, ["doc_id", "style_id"]).select("doc_id", F.col("depth").cast("int").alias("depth"))


def _order_lists(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, orders): of each customer the orders with their number of lines."""
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    # keys in sequence pack so well that counts of millions of orders pass for a small table: they are not broadcast
    orders = _table(spark, d, "orders").join(lines.hint("merge"), "o_orderkey", "left")
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")))).alias("orders"))


@query("""SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n) - 1)::INT AS place,
CASE WHEN n = 0 THEN k || '.' ELSE k || '.' || n END AS label
FROM (SELECT o_custkey, o_orderkey, 0 AS n, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders
UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber), k FROM
(SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) JOIN lineitem ON l_orderkey = o_orderkey)""")
def list_labels_decimal(spark, d):
    def describe(row):
        item = lambda level: {"num": 1, "level": level, "runs": [{"t": "x"}]}
        return {"lists": [[{"fmt": "decimal", "text": "%1."}, {"fmt": "decimal", "text": "%1.%2"}]], "blocks": [b for o in row["orders"] for b in (item(0), *[item(1)] * o["n"])]}

    return _corpus(_order_lists(spark, d), describe).labels().select("doc_id", F.element_at("path", 1).alias("place"), "label")


_ROMAN = "repeat('M', (n // 1000)::INT) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]"
_LETTERS = "CASE WHEN n > 26 THEN chr((97 + (n - 27) // 26 % 26)::INT) ELSE '' END || chr((97 + (n - 1) % 26)::INT)"


@query(f"SELECT doc_id, (n - 1)::INT AS place, {_ROMAN} || ')' AS label FROM (SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)")
def list_labels_roman(spark, d):
    docs = _table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))

    def describe(row):
        return {"lists": [[{"fmt": "upperRoman", "text": "%1)"}]], "blocks": [{"num": 1, "runs": [{"t": "x"}]} for _ in range(row["n"])]}

    return _corpus(docs, describe).labels().select("doc_id", F.element_at("path", 1).alias("place"), "label")


@query(f"SELECT p_partkey, {_ROMAN} AS roman, {_LETTERS} AS letters FROM (SELECT p_partkey, p_size AS n FROM part)")
def number_formats(spark, d):
    return _table(spark, d, "part").select("p_partkey", S.roman(F.col("p_size")).alias("roman"), S.letters(F.col("p_size")).alias("letters"))


def _sectioned(row: dict) -> dict:
    lines = _lines(row)
    last = (len(lines) - 1) // 4

    def sect(s: int) -> dict:
        refs = [("header", "default", "header1" if s % 6 == 0 else "header2")] if s % 3 == 0 else []
        return {"refs": refs + ([("footer", "default", "footer1")] if s == 1 else [])}

    blocks = []
    for k, x in enumerate(lines):
        b = {"runs": [{"t": x}]}
        if k % 4 == 3 and k // 4 < last:
            b["sect"] = sect(k // 4)
        blocks.append(b)
    return {"blocks": blocks, "sect": sect(last), "stories": {"header1": "one", "header2": "two", "footer1": "foot"}}


@query(f"SELECT doc_id, (i // 4)::INT AS section, count(*)::BIGINT AS blocks FROM ({_LINE}) GROUP BY ALL")
def section_blocks(spark, d):
    return resolve.sections(_corpus(_texts(spark, d), _sectioned).shred("blocks").blocks).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, (i // 4)::INT AS section FROM ({_LINE}))
SELECT doc_id, section, 'header' AS kind, CASE WHEN section // 3 % 2 = 0 THEN 'word/header1.xml' ELSE 'word/header2.xml' END AS part, section % 3 <> 0 AS inherited FROM s
UNION ALL SELECT doc_id, section, 'footer', 'word/footer1.xml', section > 1 FROM s WHERE section >= 1""")
def header_inheritance(spark, d):
    c = _corpus(_texts(spark, d), _sectioned).shred("section_references", "relationships")
    return resolve.header_assignment(c.section_references, c.relationships).select("doc_id", "section", "kind", "part", "inherited")


@query("SELECT doc_id, \"row\", c::INT AS cell, CASE c WHEN 0 THEN n_nationkey::VARCHAR ELSE n_name END AS text FROM (SELECT *, n_regionkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS \"row\" FROM nation), (SELECT unnest([0, 1]) AS c)")
def table_cells(spark, d):
    docs = _table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))

    def describe(row):
        return {"blocks": [{"table": [[{"t": str(r["n_nationkey"])}, {"t": r["n_name"]}] for r in row["rows"]]}]}

    t = _corpus(docs, describe).paragraph_texts().filter(F.size("block_path") == 4)
    return t.select("doc_id", F.element_at("block_path", 2).alias("row"), F.element_at("block_path", 3).alias("cell"), "text")


_CELL = "SELECT p_partkey // 10 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS cell, p_size % 3 + 1 AS span, p_size % 2 = 1 AS odd FROM part"


def _part_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("doc_id"), "p_partkey", "p_size")
    return p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("cells"))


@query(f"SELECT doc_id, cell::INT AS cell, (sum(span) OVER (PARTITION BY doc_id ORDER BY cell) - span)::INT AS \"column\", span::INT AS width FROM ({_CELL})")
def grid_offsets(spark, d):
    def describe(row):
        return {"blocks": [{"table": [[{"t": "x", "span": c["p_size"] % 3 + 1} for c in row["cells"]]]}]}

    return resolve.grid(_corpus(_part_rows(spark, d), describe).cells).select("doc_id", "cell", "column", "width")


@query(f"""SELECT doc_id, min(cell)::INT AS cell, count(*)::INT AS merged FROM
(SELECT doc_id, cell, sum(CASE WHEN odd AND cell > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY cell) AS g FROM ({_CELL})) GROUP BY doc_id, g""")
def merged_cells(spark, d):
    def describe(row):
        return {"blocks": [{"table": [[{"t": "x", "hmerge": "continue" if k and c["p_size"] % 2 else "restart"} for k, c in enumerate(row["cells"])]]}]}

    return resolve.grid(_corpus(_part_rows(spark, d), describe).cells).select("doc_id", "cell", "merged")


def _linked(row: dict) -> dict:
    return {"blocks": [{"runs": [{"t": "see "}, {"t": "page [1]", "link": (row["url"] or "") + "#top"}]}]}


@query("SELECT page_id AS doc_id, 'page [1]' AS text, coalesce(url, '') || '#top' AS url FROM pages")
def hyperlinks(spark, d):
    return _corpus(_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), _linked).links().select("doc_id", "text", "url")


@query(r"""SELECT page_id AS doc_id, '[page \[1\]](' || CASE WHEN regexp_matches(u, '\s') THEN '<' || regexp_replace(u, '([<>])', '\\\1', 'g') || '>'
ELSE regexp_replace(u, '([()<>])', '\\\1', 'g') END || ')' AS markup FROM (SELECT page_id, regexp_replace(coalesce(url, '') || '#top', '([\\&])', '\\\1', 'g') AS u FROM pages)""")
def link_markup(spark, d):
    found = _corpus(_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), _linked).links()
    return found.select("doc_id", links.markup(F.col("text"), F.col("url")).alias("markup"))


@query(_TEXT)
def field_visibility(spark, d):
    def describe(row):
        inner = [{"field": " DATE ", "t": "1 May"}]
        return {"blocks": [{"runs": [{"field": ' QUOTE "a" ', "inner": inner, "t": x}]} for x in _lines(row)]}

    return _corpus(_texts(spark, d), describe).text()


@query("SELECT doc_id, array_to_string(list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x, k: k % 2 = 1), ' ') AS text FROM documents WHERE coalesce(text, '') <> ''")
def hidden_text(spark, d):
    def describe(row):
        words = (row["text"] or "").replace("\n", " ").split(" ")
        return {"blocks": [{"runs": [{"t": (" " if k and not k % 2 else "") + w, "hidden": True if k % 2 else None} for k, w in enumerate(words)]}]}

    return _corpus(_texts(spark, d).filter("text <> ''"), describe).text()


def _conversation(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "conversations").filter(F.col("conv_id").isNotNull())
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT conv_id AS doc_id, turn::VARCHAR AS identifier, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations WHERE conv_id IS NOT NULL")
def note_refs(spark, d):
    def describe(row):
        notes = [{"id": t["turn"], "t": t["text"] or ""} for t in row["turns"]]
        return {"blocks": [{"runs": [{"t": t["role"] or ""}, {"note": t["turn"]}]} for t in row["turns"]], "notes": notes}

    c = _corpus(_conversation(spark, d), describe)
    refs = c.main.filter("kind = 'NoteReference'").select("doc_id", F.col("ident").alias("identifier"))
    return refs.join(c.stories.filter("kind = 'footnote'"), ["doc_id", "identifier"]).select("doc_id", "identifier", "text")


@query("""SELECT c.conv_id AS doc_id, c.turn::VARCHAR AS comment_id, c.role AS author, CASE WHEN c.role = 'assistant' THEN p.turn::VARCHAR END AS parent_id, c.role = 'assistant' AS done
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.conv_id IS NOT NULL""")
def comment_threads(spark, d):
    def describe(row):
        ident = lambda n: f"{n + 16:08X}"
        comments = [{"id": t["turn"], "t": "x", "author": t["role"], "para_id": ident(t["turn"]), "parent": ident(t["turn"] - 1) if t["role"] == "assistant" else None, "done": "1" if t["role"] == "assistant" else "0"} for t in row["turns"]]
        return {"blocks": [{"runs": [{"comment": t["turn"]}]} for t in row["turns"]], "comments": comments}

    c = _corpus(_conversation(spark, d), describe)
    return resolve.comment_tree(c.stories, c.threads).select("doc_id", "comment_id", "author", "parent_id", "done")


@query("SELECT conv_id AS doc_id, turn::VARCHAR AS identifier, CASE WHEN role = 'user' THEN 'missing_story' ELSE 'unreferenced_story' END AS fault FROM conversations WHERE conv_id IS NOT NULL AND role IN ('user', 'assistant')")
def anchor_mismatch(spark, d):
    def describe(row):
        return {
            "blocks": [{"runs": [{"t": "x"}, *([{"note": t["turn"]}] if t["role"] != "assistant" else [])]} for t in row["turns"]],
            "notes": [{"id": t["turn"], "t": "x"} for t in row["turns"] if t["role"] != "user"]}

    c = _corpus(_conversation(spark, d), describe)
    return resolve.anchor_faults(c.main, c.stories).select("doc_id", "identifier", "fault")


@query(f"SELECT doc_id, 'line' || i AS name, i::INT AS place FROM ({_LINE})")
def bookmark_pairs(spark, d):
    def describe(row):
        return {"blocks": [{"runs": [{"t": x, "bm": f"line{k}"}, *([{"t": "", "bm": "_GoBack"}] if not k else [])]} for k, x in enumerate(_lines(row))]}

    return resolve.bookmarks(_corpus(_texts(spark, d), describe).shred("inlines").inlines).select("doc_id", "name", F.element_at("start_path", 1).alias("place"))


@query("SELECT doc_id, p AS part_name FROM documents, (SELECT unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/_rels/document.xml.rels', 'word/styles.xml']) AS p)")
def package_parts(spark, d):
    return _corpus(_texts(spark, d), _plain).parts.select("doc_id", "part_name")


@query("SELECT page_id AS doc_id, 'word/styles.xml' AS target, false AS external FROM pages UNION ALL SELECT page_id, split_part(coalesce(url, ''), '#', 1), true FROM pages")
def relationship_targets(spark, d):
    r = _corpus(_table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), _linked).relationships
    return r.filter("owner_part = 'word/document.xml'").select("doc_id", "target", "external")


@query("""SELECT doc_id, p AS part_name, CASE WHEN p = 'word/document.xml' AND contains(coalesce(text, ''), 'the') THEN 'modified' ELSE 'unchanged' END AS change
FROM documents, (SELECT unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/_rels/document.xml.rels', 'word/styles.xml']) AS p)""")
def preservation_report(spark, d):
    parts = _corpus(_texts(spark, d), _plain).keep_parts().parts
    return resolve.part_diff(parts, edit.replace_text(parts, {"the": "THE"})).select("doc_id", "part_name", "change")


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS replaced, replace(text, 'the', 'The') AS text FROM documents WHERE coalesce(text, '') <> ''")
def replace_count(spark, d):
    # both what was replaced and what is packed and read again come of the edited parts, which are made once
    out = written(edit.replace_text(_corpus(_texts(spark, d).filter("text <> ''"), _plain).keep_parts().parts, {"the": "The"}), "edited")
    made = out.groupBy("doc_id").agg(F.sum("replaced").alias("replaced"))
    return made.join(Corpus(edit.pack(out)).text(blank=True), "doc_id").select("doc_id", "replaced", "text")


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'flat_opc' WHEN 'de' THEN 'rtf' ELSE 'docx' END AS format FROM documents")
def format_sniff(spark, d):
    docs = _texts(spark, d)
    made = make_packages(docs, _plain)
    flat = package.pack(package.parts(made), "flat_opc").withColumnRenamed("content", "flat")
    both = made.join(flat, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    content = F.when(F.col("lang") == "fr", F.col("flat")).when(F.col("lang") == "de", F.lit(bytearray(b"{\\rtf1 x}"))).otherwise(F.col("content"))
    return both.select("doc_id", package.sniff(content).alias("format"))


@query("SELECT doc_id, 'unsupported_construct' AS code, 'ins x ' || len(string_split(coalesce(text, ''), chr(10))) AS message FROM documents WHERE lang = 'de'")
def diagnostic_summary(spark, d):
    def describe(row):
        return {"blocks": [{"runs": [{"t": x, **({"wrap": "ins"} if row["lang"] == "de" else {})}]} for x in _lines(row)]}

    return _corpus(_texts(spark, d), describe).diagnostics().select("doc_id", "code", "message")


@query("SELECT 1::BIGINT AS images, count(*)::BIGINT AS documents FROM part")
def media_dedup(spark, d):
    png = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000001000000010806000000")

    def describe(row):
        return {"blocks": [{"runs": [{"t": "x"}]}], "media": {"image1.png": png}}

    c = _corpus(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id")), describe)
    return c.parts.filter(F.col("part_name").startswith("word/media/")).agg(F.countDistinct("sha256").alias("images"), F.count(F.lit(1)).alias("documents"))


@query(ORACLES["plain_text"])
def flat_opc_roundtrip(spark, d):
    return _corpus(_texts(spark, d), _plain).recoded("flat_opc").text()


@query(ORACLES["plain_text"])
def docx_roundtrip(spark, d):
    return _corpus(_texts(spark, d), _plain).recoded("docx").text()


@query(f"""SELECT doc_id, 1::INT AS schema_version, count(*)::BIGINT AS blocks, count(*) FILTER (WHERE i = 0)::BIGINT AS headings, 'sections[0].body.children[0]' AS first_location, sum(length(line))::BIGINT AS chars FROM ({_LINE}) GROUP BY doc_id""")
def export_json(spark, d):
    def describe(row):
        return {"blocks": [{"style": "Heading1" if k == 0 else None, "runs": [{"t": x}]} for k, x in enumerate(_lines(row))]}

    j = _corpus(_texts(spark, d), describe).export()
    j = j.withColumn("e", F.from_json("json", "schema_version int, blocks array<struct<location: string, text: string, heading_level: int>>"))
    return j.select("doc_id", F.col("e.schema_version").alias("schema_version"), F.size("e.blocks").cast("long").alias("blocks"), F.size(F.filter("e.blocks", lambda b: b["heading_level"].isNotNull())).cast("long").alias("headings"),
                    F.element_at("e.blocks", 1)["location"].alias("first_location"), F.aggregate("e.blocks", F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.length(b["text"]), F.lit(0))).alias("chars"))


@query("SELECT conv_id AS doc_id, 3::BIGINT AS parts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def reachable_parts(spark, d):
    def describe(row):
        return {"blocks": [{"runs": [{"note": t["turn"]}]} for t in row["turns"]], "notes": [{"id": t["turn"], "t": "x"} for t in row["turns"]]}

    return resolve.reachable_parts(_corpus(_conversation(spark, d), describe).relationships).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT doc_id, 'Override' AS scope, p AS key FROM documents, (SELECT unnest(['word/document.xml', 'word/styles.xml']) AS p) UNION ALL SELECT doc_id, 'Default', e FROM documents, (SELECT unnest(['rels', 'xml', 'png']) AS e)")
def content_types(spark, d):
    return _corpus(_texts(spark, d), _plain).shred("content_types").content_types.select("doc_id", "scope", "key")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Letter' WHEN p_size % 3 = 1 THEN 'A4' ELSE 'Custom' END AS paper, floor(p_size / 3.0 * 2 + 0.5) / 2 AS half_points FROM part")
def page_measures(spark, d):
    n = F.col("p_size") % 3
    w, h = F.when(n == 0, 612.0).when(n == 1, 842.0).otherwise(500.0), F.when(n == 0, 792.0).when(n == 1, 595.0).otherwise(500.0)
    return _table(spark, d, "part").select("p_partkey", S.paper_size(w, h).alias("paper"), S.half_point_size(F.col("p_size") / 3.0).alias("half_points"))


@query("SELECT c_custkey, CASE WHEN v > 2147483647 THEN v - 4294967296 ELSE v END AS note_id FROM (SELECT c_custkey, c_custkey * 3000000 % 4294967296 AS v FROM customer)")
def note_ids(spark, d):
    return _table(spark, d, "customer").select("c_custkey", S.note_id((F.col("c_custkey") * 3000000).cast("string")).alias("note_id"))


@query("SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(13)) || chr(12) AS text FROM documents")
def dom_text(spark, d):
    return _corpus(_texts(spark, d), _plain).dom_text()


@query("SELECT n_regionkey::BIGINT AS doc_id, string_agg(n_nationkey::VARCHAR || chr(7) || n_name || chr(7) || chr(7), '' ORDER BY n_nationkey) || 'end' || chr(12) AS text FROM nation GROUP BY n_regionkey")
def dom_table_text(spark, d):
    docs = _table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))

    def describe(row):
        return {"blocks": [{"table": [[{"t": str(r["n_nationkey"])}, {"t": r["n_name"]}] for r in row["rows"]]}, {"runs": [{"t": "end"}]}]}

    return _corpus(docs, describe).dom_text()


@query("SELECT doc_id, ((length(text) - length(replace(text, 'e t', ''))) // 3)::BIGINT AS replaced, string_agg(replace(line, 'e t', 'E+T'), chr(10) ORDER BY i) AS text FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE coalesce(text, '') <> '') WHERE line <> '' GROUP BY doc_id, text")
def replace_over_runs(spark, d):
    def describe(row):
        split = lambda x: [w if not k else " " + w for k, w in enumerate(x.split(" "))]
        return {"blocks": [{"runs": [{"t": w, "b": True if k % 2 else None} for k, w in enumerate(split(x))]} for x in _lines(row)]}

    docs = _texts(spark, d).filter(F.translate("text", "\n", "") != "")
    out = edit.replace_in_paragraphs(_corpus(docs, describe).parts, "e t", "E+T")
    made = out.groupBy("doc_id").agg(F.sum("replaced").alias("replaced"))
    return made.join(Corpus(edit.pack(out)).text(), "doc_id").select("doc_id", "replaced", "text")


@query("SELECT conv_id AS doc_id, turn::VARCHAR AS old_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) + 1)::INT AS new_id FROM conversations WHERE conv_id IS NOT NULL")
def note_renumbering(spark, d):
    def describe(row):
        return {"blocks": [{"runs": [{"note": t["turn"]}]} for t in reversed(row["turns"])], "notes": [{"id": t["turn"], "t": "x"} for t in row["turns"]] + [{"id": 9999, "t": "unused"}]}

    c = _corpus(_conversation(spark, d), describe)
    return identity.renumbered(c.main, c.stories).select("doc_id", "old_id", "new_id")


@query("""WITH c AS (SELECT n_regionkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT doc_id, r AS "row", k::INT AS cell, CASE WHEN r = 0 THEN ['nwCell', 'firstRow', 'neCell'][k + 1] WHEN r = n - 1 THEN ['swCell', 'lastRow', 'seCell'][k + 1]
ELSE ['firstCol', CASE WHEN r % 2 = 1 THEN 'band1Horz' ELSE 'band2Horz' END, 'lastCol'][k + 1] END AS region FROM c, (SELECT unnest([0, 1, 2]) AS k)""")
def conditional_regions(spark, d):
    docs = _table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    c = _corpus(docs, lambda row: {"blocks": [{"table": [[{"t": "x"}] * 3] * row["n"], "tblpr": '<w:tblLook w:val="01E0"/>'}]})
    return cascade.cell_regions(c.cells, cascade.table_frames(c.blocks, c.properties, c.styles)).select("doc_id", "row", "cell", F.element_at("regions", -1).alias("region"))


def _binary(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            yield pa.record_batch([part.column("doc_id"), pa.array([legacy.build(t or "") for t in part.column("text").to_pylist()], pa.binary())], ["doc_id", "content"])


@query(f"SELECT doc_id, i::INT AS place, line AS text, false AS in_table FROM ({_LINE})")
def binary_doc_text(spark, d):
    made = _texts(spark, d).select("doc_id", "text").mapInArrow(_binary, "doc_id long, content binary")
    return legacy.doc_paragraphs(made).select("doc_id", "place", "text", "in_table")


def _parts_of(spark: SparkSession, d: str, describe) -> Corpus:
    """A corpus of one package for each part, described from its size n."""
    return _corpus(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n")), lambda row: describe(row["n"]))


_N = "SELECT p_partkey AS doc_id, p_size AS n FROM part"
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@query(f"""SELECT doc_id, CASE WHEN n % 2 = 0 THEN 1 ELSE 3 END::INT AS alignment, n::DOUBLE AS left_indent, CASE WHEN n % 3 = 0 THEN -12.0 ELSE 6.5 END::DOUBLE AS first_line_indent,
n / 2.0 AS space_before, CASE WHEN n % 10 = 0 THEN false WHEN n % 5 = 0 THEN true END AS keep_next, CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 THEN 2 END::INT AS line_rule FROM ({_N})""")
def paragraph_format(spark, d):
    def describe(n):
        rule = ' w:lineRule="exact"' if n % 4 == 0 else ' w:lineRule="auto"' if n % 4 == 1 else ""
        keep = '<w:keepNext w:val="0"/>' if n % 10 == 0 else "<w:keepNext/>" if n % 5 == 0 else ""
        first = 'w:hanging="240"' if n % 3 == 0 else 'w:firstLine="130"'
        return {"blocks": [{"runs": [{"t": "x"}], "ppr": f'{keep}<w:spacing w:before="{n * 10}" w:line="300"{rule}/><w:ind w:left="{n * 20}" {first}/><w:jc w:val="{"both" if n % 2 else "center"}"/>'}]}

    f = properties.paragraph_formats(_parts_of(spark, d, describe).shred("properties").properties)
    return f.select("doc_id", "alignment", "left_indent", "first_line_indent", "space_before", F.col("keepNext").alias("keep_next"), "line_rule")


@query(f"""SELECT doc_id, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END::INT AS alignment, 6.0::DOUBLE AS space_after, CASE WHEN n % 3 = 0 THEN 10.0 WHEN n % 2 = 0 THEN 5.0 END::DOUBLE AS left_indent, n % 5 <> 0 AS keep_lines FROM ({_N})""")
def paragraph_cascade(spark, d):
    def describe(n):
        styles = [{"id": "Base", "name": "Base", "default": True, "ppr": '<w:keepLines/><w:spacing w:after="120"/><w:jc w:val="center"/>'}, {"id": "Para", "name": "Para", "base": "Base", "ppr": '<w:ind w:left="100"/><w:jc w:val="right"/>'}]
        direct = ('<w:keepLines w:val="off"/>' if n % 5 == 0 else "") + ('<w:ind w:left="200"/>' if n % 3 == 0 else "")
        return {"styles": styles, "blocks": [{"style": None if n % 2 else "Para", "runs": [{"t": "x"}], "ppr": direct}]}

    return _parts_of(spark, d, describe).paragraph_formats().select("doc_id", "alignment", "space_after", "left_indent", F.col("keepLines").alias("keep_lines"))


_THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme><a:dk1><a:sysClr lastClr="000000"/></a:dk1><a:lt1><a:srgbClr val="ffffff"/></a:lt1><a:accent1><a:srgbClr val="808080"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Major"/></a:majorFont><a:minorFont><a:latin typeface="Minor"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'


@query(f"""SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'Own' WHEN n % 3 = 1 THEN 'Minor' ELSE 'Major' END AS name, CASE WHEN n % 2 = 0 THEN 3 ELSE 1 END::INT AS underline,
n % 5 = 0 AS superscript, 'Color [A=255, R=' || n || ', G=0, B=255]' AS color, CASE WHEN n % 7 = 0 THEN 'Color [A=255, R=128, G=0, B=0]' END AS highlight, n / 2.0 AS size FROM ({_N})""")
def run_font(spark, d):
    def describe(n):
        name = '<w:rFonts w:hAnsi="Own"/>' if n % 3 == 0 else f'<w:rFonts w:{"asciiTheme" if n % 2 else "hAnsiTheme"}="{"minor" if n % 3 == 1 else "major"}HAnsi"/>'
        more = f'<w:color w:val="{n:02X}00FF"/><w:u w:val="{"odd" if n % 2 else "double"}"/><w:vertAlign w:val="{"superscript" if n % 5 == 0 else "baseline"}"/><w:sz w:val="{n}"/>' + ('<w:highlight w:val="darkRed"/>' if n % 7 == 0 else "")
        return {"blocks": [{"runs": [{"t": "x", "rpr": name + more}]}], "raw_parts": {"theme": _THEME}}

    c = _parts_of(spark, d, describe).shred("properties", "theme_slots")
    return properties.fonts(c.properties, c.theme_slots).select("doc_id", "name", "underline", "superscript", "color", "highlight", "size")


@query(f"""SELECT doc_id, 'Color [A=255, R=' || v || ', G=' || v || ', B=' || v || ']' AS shown FROM (SELECT doc_id, CASE WHEN n % 4 = 0 THEN 18
WHEN n % 4 = 1 THEN floor((128 / 255.0 + (1 - 128 / 255.0) * (1 - (n * 5) / 255.0)) * 255 + 1e-9) WHEN n % 4 = 2 THEN floor(128 / 255.0 * (n * 5) / 255.0 * 255 + 1e-9) ELSE 255 END::INT AS v FROM ({_N}))""")
def theme_colors(spark, d):
    def describe(n):
        mods = {0: 'w:themeColor="accent1" w:themeTint="80" w:themeShade="80"', 1: f'w:themeColor="accent1" w:themeTint="{n * 5:02X}"', 2: f'w:themeColor="accent1" w:themeShade="{n * 5:02X}"', 3: 'w:themeColor="background1"'}
        return {"blocks": [{"runs": [{"t": "x", "rpr": f'<w:color w:val="121212" {mods[n % 4]}/>'}]}], "raw_parts": {"theme": _THEME}}

    c = _parts_of(spark, d, describe).shred("properties", "theme_slots")
    return properties.fonts(c.properties, c.theme_slots).select("doc_id", F.col("shown_color").alias("shown"))


@query(f"""SELECT doc_id, 0 AS section, CASE WHEN n % 2 = 0 THEN 842.0 ELSE 612.0 END::DOUBLE AS page_width, CASE WHEN n % 2 = 0 THEN 'A4' ELSE 'Letter' END AS paper, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END::INT AS orientation,
n::DOUBLE AS margin_top, 0.0::DOUBLE AS margin_left, CASE WHEN n % 3 = 0 THEN 0 ELSE 2 END::INT AS start, n % 5 = 0 AS different_first_page, CASE WHEN n % 7 = 0 THEN n END::INT AS first_number, (n % 3 + 1)::INT AS columns, n % 4 <> 0 AS even_columns FROM ({_N})""")
def page_setup(spark, d):
    def describe(n):
        raw = f'<w:pgMar w:top="{n * 20}" w:left="x"/>' + ('<w:type w:val="continuous"/>' if n % 3 == 0 else "") + ("<w:titlePg/>" if n % 5 == 0 else "") + (f'<w:pgNumType w:start="{n}"/>' if n % 7 == 0 else "")
        raw += f'<w:cols w:num="{n % 3 + 1}" w:space="720"{" w:equalWidth=\"0\"" if n % 4 == 0 else ""}/>'
        size = {"w": 16840, "h": 11900} if n % 2 == 0 else {}
        return {"blocks": [{"runs": [{"t": "x"}]}], "sect": {**size, "raw": raw}}

    f = properties.page_setups(_parts_of(spark, d, describe).shred("properties").properties)
    landscape = F.when(F.col("page_width") > F.col("page_height"), 2).otherwise(F.col("orientation"))
    return f.select("doc_id", "section", "page_width", "paper", landscape.alias("orientation"), "margin_top", "margin_left", "start", "different_first_page", "first_number", "columns", "even_columns")


@query(f"""SELECT doc_id, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END::INT AS width_type, CASE WHEN n % 2 = 0 THEN n ELSE n * 2.5 END::DOUBLE AS width, n % 3 = 0 AS first_row, n % 5 <> 0 AS row_bands, 7.5::DOUBLE AS left_indent, n % 4 = 0 AS bidi,
1.5::DOUBLE AS padding_left, 'T' || n AS title FROM ({_N})""")
def table_format(spark, d):
    def describe(n):
        bits = (0x20 if n % 3 == 0 else 0) | (0x200 if n % 2 == 0 else 0)
        look = f'<w:tblLook w:val="{bits:04X}" w:noHBand="{1 if n % 5 == 0 else 0}"/>'
        width = f'<w:tblW w:type="pct" w:w="{n * 50}"/>' if n % 2 == 0 else f'<w:tblW w:type="dxa" w:w="{n * 50}"/>'
        bidi = '<w:bidiVisual w:val="%s"/>' % ("on" if n % 4 == 0 else "0")
        return {"blocks": [{"table": [[{"t": "x"}]], "tblpr": f'{bidi}{width}<w:tblInd w:w="150"/><w:tblCellMar><w:start w:w="30"/></w:tblCellMar>{look}<w:tblCaption w:val="T{n}"/>'}]}

    f = properties.table_formats(_parts_of(spark, d, describe).shred("properties").properties)
    return f.select("doc_id", F.col("width.type").alias("width_type"), F.col("width.value").alias("width"), F.col("look.first_row").alias("first_row"), F.col("look.row_bands").alias("row_bands"), "left_indent", "bidi", "padding_left", "title")


@query(f"""SELECT doc_id, CASE n % 4 WHEN 0 THEN 0.0 WHEN 1 THEN n ELSE n * 72.0 END::DOUBLE AS height, CASE WHEN n % 4 = 0 THEN 2 WHEN n % 4 = 1 THEN 1 ELSE 0 END::INT AS height_rule,
CASE WHEN n % 3 = 0 THEN false WHEN n % 3 = 1 THEN true END AS may_break, n % 5 = 0 AS heading FROM ({_N})""")
def row_format(spark, d):
    def describe(n):
        height = {0: '<w:trHeight w:val="4294967296" w:hRule="exact"/>', 1: f'<w:trHeight w:val="{n * 20}" w:hRule="exact"/>'}.get(n % 4, f'<w:trHeight w:val="{n}in"/>')
        split = {0: "<w:cantSplit/>", 1: '<w:cantSplit w:val="off"/>'}.get(n % 3, "")
        return {"blocks": [{"table": [[{"t": "x"}]], "trpr": [height + split + ("<w:tblHeader/>" if n % 5 == 0 else "")]}]}

    return properties.row_formats(_parts_of(spark, d, describe).shred("properties").properties).select("doc_id", "height", "height_rule", "may_break", "heading")


@query(f"""SELECT doc_id, n::DOUBLE AS width, CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS vertical_alignment, n % 4 = 0 AS wraps, 2::INT AS direction, 'FF00' || lpad(n::VARCHAR, 2, '0') AS background,
6::INT AS line_style, n / 8.0 AS border_width, 3.0::DOUBLE AS padding_right FROM ({_N})""")
def cell_format(spark, d):
    def describe(n):
        align = {0: "bottom", 1: "center", 2: "odd"}[n % 3]
        wrap = '<w:noWrap w:val="0"/>' if n % 4 == 0 else "<w:noWrap/>"
        return {"blocks": [{"table": [[{"t": "x", "tcpr": f'<w:tcW w:type="dxa" w:w="{n * 20}"/><w:tcBorders><w:end w:val="dotted" w:sz="{n}" w:color="auto"/></w:tcBorders><w:shd w:val="clear" w:color="auto" w:fill="FF00{n:02d}"/>{wrap}<w:tcMar><w:right w:w="60" w:type="dxa"/></w:tcMar><w:textDirection w:val="tbRl"/><w:vAlign w:val="{align}"/>'}]]}]}

    f = properties.cell_formats(_parts_of(spark, d, describe).shred("properties").properties)
    return f.select("doc_id", F.col("width.value").alias("width"), "vertical_alignment", "wraps", "direction", F.col("shading.background").alias("background"), F.col("border_right.line_style").alias("line_style"), F.col("border_right.width").alias("border_width"), "padding_right")


@query(f"""SELECT doc_id, k::INT AS place, (k + 1) * 36.0 AS position, CASE WHEN k = 0 THEN 2 ELSE 0 END::INT AS alignment, CASE WHEN k = 1 THEN 1 ELSE 0 END::INT AS leader, 36.0 * (n % 3 + 1) AS behind FROM ({_N}), (SELECT unnest(range(3)) AS k) WHERE k <= n % 3""")
def tab_stops(spark, d):
    def describe(n):
        tab = lambda k: f'<w:tab w:val="{"right" if k == 0 else "left"}" w:pos="{(k + 1) * 720}"{" w:leader=\"dot\"" if k == 1 else ""}/>'
        return {"blocks": [{"runs": [{"t": "x"}], "ppr": f"<w:tabs>{''.join(tab(k) for k in range(n % 3 + 1))}</w:tabs>"}]}

    f = properties.paragraph_formats(_parts_of(spark, d, describe).shred("properties").properties)
    behind = properties.previous_tab(F.col("tab_stops"), F.lit(1000.0))["position"].alias("behind")
    return f.select("doc_id", F.posexplode("tab_stops").alias("place", "t"), behind).select("doc_id", "place", "t.position", "t.alignment", "t.leader", "behind")


@query(f"SELECT doc_id, CASE n % 3 WHEN 0 THEN [36.0, 72.0] WHEN 1 THEN [36.0] ELSE [36.0, 72.0, 108.0] END::DOUBLE[] AS positions FROM ({_N})")
def merged_tab_stops(spark, d):
    def describe(n):
        own = {1: '<w:tabs><w:tab w:val="clear" w:pos="1440"/></w:tabs>', 2: '<w:tabs><w:tab w:val="left" w:pos="2160"/></w:tabs>'}.get(n % 3, "<w:keepNext/>")
        return {"styles": [{"id": "S", "name": "S", "ppr": '<w:tabs><w:tab w:val="left" w:pos="720"/><w:tab w:val="left" w:pos="1440"/></w:tabs>'}], "blocks": [{"style": "S", "runs": [{"t": "x"}], "ppr": own}]}

    return _parts_of(spark, d, describe).paragraph_formats().select("doc_id", F.col("tab_stops.position").alias("positions"))


@query(f"""SELECT doc_id, 1 AS list_id, k::INT AS level, CASE k WHEN 0 THEN 0 ELSE 23 END::INT AS number_style, (CASE k WHEN 0 THEN CASE WHEN n % 2 = 0 THEN n ELSE 3 END ELSE 0 END)::INT AS start_at,
(n * 20 - 18 * k) / 20.0 AS number_position, n::DOUBLE AS text_position, CASE k WHEN 0 THEN 'space' ELSE 'tab' END AS suffix, true AS multilevel FROM ({_N}), (SELECT unnest(range(2)) AS k)""")
def list_level_format(spark, d):
    def describe(n):
        level = lambda k: f'<w:lvl w:ilvl="{k}">{"<w:start w:val=\"3\"/>" if k == 0 else ""}<w:numFmt w:val="{"bullet" if k else "decimal"}"/>{"<w:suff w:val=\"space\"/>" if k == 0 else ""}<w:lvlText w:val="%1"/><w:pPr><w:ind w:left="{n * 20}" w:hanging="{18 * k}"/></w:pPr></w:lvl>'
        start = f'<w:lvlOverride w:ilvl="0"><w:startOverride w:val="{n}"/></w:lvlOverride>' if n % 2 == 0 else ""
        return {"blocks": [{"runs": [{"t": "x"}]}], "raw_parts": {"numbering": f'<w:numbering {_WORD}><w:abstractNum w:abstractNumId="7">{level(0)}{level(1)}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/>{start}</w:num></w:numbering>'}}

    return _parts_of(spark, d, describe).shred("list_levels").list_levels.select("doc_id", "list_id", "level", "number_style", "start_at", "number_position", "text_position", "suffix", "multilevel")


@query(f"SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'B' ELSE 'A' END || '.' AS label FROM ({_N}) WHERE n % 5 <> 0")
def style_list_labels(spark, d):
    def describe(n):
        num = lambda k: f'<w:numPr><w:numId w:val="{k}"/></w:numPr>'
        styles = [{"id": "Base", "name": "Base", "ppr": num(1)}, {"id": "Item", "name": "Item", "base": "Base"}]
        direct = num(0) if n % 5 == 0 else num(2) if n % 3 == 0 else ""
        return {"styles": styles, "lists": [[{"fmt": "upperLetter", "text": "%1."}], [{"fmt": "upperLetter", "text": "%1.", "start": 2}]], "blocks": [{"style": "Item", "runs": [{"t": "x"}], "ppr": direct}]}

    return _parts_of(spark, d, describe).labels().select("doc_id", "label")


@query(f"""SELECT doc_id, 'S' || n AS style_id, CASE n % 4 WHEN 0 THEN 'TOC ' || n WHEN 1 THEN 'Table of Figures' WHEN 2 THEN 'MyOwn style' ELSE 'Body Text ' || n END AS name,
CASE WHEN n % 2 = 0 THEN 'Next' ELSE 'S' || n END AS next_id, n::INT AS priority, n % 3 = 0 AS quick, n % 4 IN (0, 1) AS contents FROM ({_N})""")
def style_record(spark, d):
    def describe(n):
        name = {0: f"toc {n}", 1: "table of figures", 2: "MyOwn style", 3: f"body text {n}"}[n % 4]
        raw = ('<w:next w:val="Next"/>' if n % 2 == 0 else "") + f'<w:uiPriority w:val="{n}"/>' + ("<w:qFormat/>" if n % 3 == 0 else "")
        return {"styles": [{"id": f"S{n}", "name": name, "raw": raw}], "blocks": [{"runs": [{"t": "x"}]}]}

    f = properties.style_records(_parts_of(spark, d, describe).shred("styles").styles)
    return f.select("doc_id", "style_id", "name", "next_id", "priority", "quick", (S.is_contents_style(F.col("name")) | (F.col("name") == "Table of Figures")).alias("contents"))


@query(f"SELECT doc_id, 'My Style' AS name, CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS style_id FROM ({_N})")
def style_lookup(spark, d):
    def describe(n):
        names = {0: ["My Style", "my style"], 1: ["other", "MY style"], 2: ["other", "none"]}[n % 3]
        return {"styles": [{"id": i, "name": x} for i, x in zip("AB", names, strict=True)], "blocks": [{"runs": [{"t": "x"}]}]}

    c = _parts_of(spark, d, describe).shred("styles", "blocks")
    return properties.style_by_name(c.styles, c.blocks.select("doc_id", F.lit("My Style").alias("name")))


@query(f"""SELECT doc_id, kind, CASE WHEN kind = 'footnote' THEN CASE WHEN n % 2 = 0 THEN 'upperRoman' WHEN n % 3 = 0 THEN 'lowerLetter' ELSE 'decimal' END ELSE 'lowerRoman' END AS number_format,
CASE WHEN kind = 'footnote' THEN 'pageBottom' ELSE CASE WHEN n % 5 = 0 THEN 'sectEnd' ELSE 'docEnd' END END AS position, CASE WHEN kind = 'footnote' THEN CASE WHEN n % 2 = 0 THEN n ELSE 1 END ELSE 1 END::BIGINT AS start FROM ({_N}), (SELECT unnest(['footnote', 'endnote']) AS kind)""")
def note_options(spark, d):
    def describe(n):
        own = f'<w:footnotePr><w:numFmt w:val="upperRoman"/><w:numStart w:val="{n}"/></w:footnotePr>' if n % 2 == 0 else ""
        whole = ('<w:footnotePr><w:numFmt w:val="lowerLetter"/></w:footnotePr>' if n % 3 == 0 else "") + ('<w:endnotePr><w:pos w:val="sectEnd"/></w:endnotePr>' if n % 5 == 0 else "")
        return {"blocks": [{"runs": [{"t": "x"}]}], "sect": {"raw": own}, "raw_parts": {"settings": f"<w:settings {_WORD}><w:zoom/>{whole}</w:settings>"}}

    return properties.note_options(_parts_of(spark, d, describe).shred("properties").properties).select("doc_id", "kind", "number_format", "position", "start")


@query(f"SELECT doc_id, name, CASE name WHEN 'noLeading' THEN n % 2 = 0 ELSE true END AS enabled, CASE WHEN n % 3 = 0 THEN 36.0 ELSE n END::DOUBLE AS default_tab FROM ({_N}), (SELECT unnest(['noLeading', 'wrapTrailSpaces']) AS name)")
def compatibility_switches(spark, d):
    def describe(n):
        tab = "" if n % 3 == 0 else f'<w:defaultTabStop w:val="{n * 20}"/>'
        return {"blocks": [{"runs": [{"t": "x"}]}], "raw_parts": {"settings": f'<w:settings {_WORD}>{tab}<w:compat><w:noLeading w:val="{"true" if n % 2 == 0 else "false"}"/><w:wrapTrailSpaces/><w:compatSetting w:name="m" w:val="15"/></w:compat></w:settings>'}}

    p = _parts_of(spark, d, describe).shred("properties").properties
    return properties.compatibility(p).join(properties.document_settings(p).select("doc_id", "default_tab"), "doc_id")


@query(f"SELECT doc_id, 'arial' AS key, 'ARIAL' AS name, CASE WHEN n % 2 = 0 THEN 'swiss' ELSE 'roman' END AS family, 'fixed' AS pitch, n % 3 = 0 AS embedded FROM ({_N})")
def font_registrations(spark, d):
    def describe(n):
        late = '<w:family w:val="swiss"/>' if n % 2 == 0 else ""
        body = '<w:font w:name="Arial"><w:family w:val="roman"/><w:pitch w:val="fixed"/></w:font>' + f'<w:font w:name="ARIAL">{late}{"<w:embedRegular/>" if n % 3 == 0 else ""}</w:font>'
        return {"blocks": [{"runs": [{"t": "x"}]}], "raw_parts": {"fontTable": f"<w:fonts {_WORD}>{body}</w:fonts>"}}

    return properties.registered_fonts(_parts_of(spark, d, describe).shred("font_table").font_table).select("doc_id", "key", "name", "family", "pitch", "embedded")


@query("""SELECT page_id AS doc_id, k::INT AS place, CASE k WHEN 0 THEN 'see ' WHEN 1 THEN 'a]b' ELSE ' end' END AS text, CASE WHEN k = 1 THEN 'http://h/' || page_id || '(x) y' END AS url FROM pages, (SELECT unnest(range(3)) AS k)""")
def link_segments(spark, d):
    text = F.concat(F.lit("see [a\\]b](<http://h/"), F.col("page_id"), F.lit("(x) y> \"title\") end"))
    return _table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(links.segments(text)).alias("place", "s")).select("doc_id", "place", "s.text", "s.url")


@query(f"SELECT doc_id, 1 AS place FROM ({_N}) WHERE n % 3 = 1")
def page_breaks(spark, d):
    def describe(n):
        more = {0: {"t": "ink"}, 1: {"t": "  "}, 2: {"raw": '<w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="12700" cy="25400"/></wp:inline></w:drawing></w:r>'}}[n % 3]
        return {"blocks": [{"runs": [{"t": "x"}]}, {"runs": [{"raw": '<w:r><w:br w:type="page"/></w:r>'}, more]}]}

    c = _parts_of(spark, d, describe).shred("inlines", "drawings")
    return resolve.pure_page_breaks(resolve.visible(c.main), c.drawings).select("doc_id", F.element_at("block_path", 1).alias("place"))


def _picture(n: int, name: str) -> str:
    place = f'<wp:positionH relativeFrom="page"><wp:posOffset>{n * 12700}</wp:posOffset></wp:positionH><wp:positionV relativeFrom="margin"><wp:posOffset>0</wp:posOffset></wp:positionV>'
    space = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    blip = '<a:graphic><a:graphicData><a:blip r:embed="rId9"/></a:graphicData></a:graphic>'
    kind = "anchor" if n % 2 else "inline"
    extra = f'{place}<wp:wrapSquare/>' if n % 2 else ""
    return f'<w:r><w:drawing><wp:{kind} {space}{" behindDoc=\"1\"" if n % 2 else ""}>{extra}<wp:extent cx="{n * 12700}" cy="25400"/><wp:docPr id="1" name="{name}" descr="about {n}"/>{blip}</wp:{kind}></w:drawing></w:r>'


@query(f"""SELECT doc_id, CASE WHEN n % 2 = 1 THEN 'anchor' ELSE 'inline' END AS kind, 'about ' || n AS alternative_text, n::DOUBLE AS width, 2.0::DOUBLE AS height, CASE WHEN n % 2 = 1 THEN n END::DOUBLE AS x,
CASE WHEN n % 2 = 1 THEN 'page' END AS horizontal_from, CASE WHEN n % 2 = 1 THEN 'Square' END AS wrap, CASE WHEN n % 2 = 1 THEN true END AS behind FROM ({_N})""")
def drawing_places(spark, d):
    c = _parts_of(spark, d, lambda n: {"blocks": [{"runs": [{"t": "x"}, {"raw": _picture(n, "p")}]}]}).shred("drawings")
    return c.drawings.select("doc_id", "kind", "alternative_text", "width", "height", "x", "horizontal_from", "wrap", "behind")


@query(f"""SELECT doc_id, 'a' || n || chr(10) || 'b' AS first_cell, 2 AS span, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END::INT AS merge, 1::BIGINT AS rows, 'page' AS link_text, 'http://h#top' AS link, 'footnote' AS note, n::DOUBLE AS image_width FROM ({_N})""")
def export_tables(spark, d):
    def describe(n):
        cells = [{"blocks": [{"runs": [{"t": f"a{n}"}]}, {"runs": []}, {"table": [[{"t": "inner"}]]}, {"runs": [{"t": "b"}]}], "span": 2, "vmerge": "restart" if n % 2 == 0 else None}, {"t": "c"}]
        return {"blocks": [{"table": [cells]}, {"runs": [{"t": "see "}, {"t": "page", "link": "http://h#top"}, {"note": 1}, {"raw": _picture(n, "p")}]}], "notes": [{"id": 1, "t": "n"}]}

    kind = "blocks array<struct<rows: array<struct<cells: array<struct<grid_span: int, vertical_merge: int, text: string>>>>, runs: array<struct<text: string, link: string>>, note_references: array<struct<kind: string>>, images: array<struct<width_pt: double>>>>"
    j = _parts_of(spark, d, describe).export().withColumn("e", F.from_json("json", kind))
    cell, second = F.col("e.blocks")[0]["rows"][0]["cells"][0], F.col("e.blocks")[1]
    return j.select("doc_id", cell["text"].alias("first_cell"), cell["grid_span"].alias("span"), cell["vertical_merge"].alias("merge"), F.size(F.col("e.blocks")[0]["rows"]).cast("long").alias("rows"), second["runs"][1]["text"].alias("link_text"),
                    second["runs"][1]["link"].alias("link"), second["note_references"][0]["kind"].alias("note"), second["images"][0]["width_pt"].alias("image_width"))


@query(f"SELECT doc_id, CASE WHEN n % 2 = 0 THEN '  pad' || n || '  ' ELSE 'pad' || n END || 'x y' AS text FROM ({_N})")
def text_space(spark, d):
    def describe(n):
        keep = ' xml:space="preserve"' if n % 2 == 0 else ""
        return {"blocks": [{"runs": [{"raw": f"<w:r><w:t{keep}>  pad{n}  </w:t></w:r><w:r><w:t>\n x\ty \r\n</w:t></w:r>"}]}]}

    return _parts_of(spark, d, describe).text()


@query(f"SELECT doc_id, k::INT AS place, ['Run', 'NoteReference', 'Run', 'CommentMarker'][k + 1] AS kind, ['a', 'footnote', 'b' || n, NULL][k + 1] AS text FROM ({_N}), (SELECT unnest(range(4)) AS k)")
def mark_order(spark, d):
    def describe(n):
        return {"blocks": [{"runs": [{"raw": f'<w:r><w:t>a</w:t><w:footnoteReference w:id="1"/><w:t>b{n}</w:t><w:commentReference w:id="1"/></w:r>'}]}]}

    return _parts_of(spark, d, describe).shred("inlines").main.select("doc_id", F.col("ord").alias("place"), "kind", "text")


@query(f"""WITH c AS (SELECT doc_id, n, unnest([n::DOUBLE, 22.5, 22.5]) AS w, unnest(range(3)) AS k FROM ({_N})),
t AS (SELECT doc_id, k, CASE WHEN n % 2 = 0 THEN least(200.0, 100.0) ELSE 200.0 * 0.5 END AS room, w, n FROM c)
SELECT doc_id, k::INT AS "column", round(CASE WHEN k = 0 AND n % 3 = 0 THEN CASE WHEN 45.0 + greatest(room - 45.0, room / 3) > room THEN greatest(room - 45.0, room / 3) * room / (45.0 + greatest(room - 45.0, room / 3)) ELSE greatest(room - 45.0, room / 3) END
WHEN n % 3 = 0 THEN CASE WHEN 45.0 + greatest(room - 45.0, room / 3) > room THEN w * room / (45.0 + greatest(room - 45.0, room / 3)) ELSE w END
WHEN n + 45.0 > room THEN w * room / (n + 45.0) ELSE w END, 6) AS width FROM t""")
def column_widths(spark, d):
    def describe(n):
        wide = lambda w: f'<w:tcW w:type="dxa" w:w="{w}"/>'
        rows = [[{"t": "x", "tcpr": wide(n * 20) if n % 3 else ""}, {"t": "x", "span": 2, "tcpr": wide(900)}], [{"t": "x", "span": 2}, {"t": "x"}], [{"t": "x"}, {"t": "x", "tcpr": wide(400)}, {"t": "x", "tcpr": '<w:tcW w:type="pct" w:w="5000"/>'}]]
        return {"blocks": [{"table": rows, "grid": [200], "tblpr": '<w:tblW w:type="dxa" w:w="2000"/>' if n % 2 == 0 else '<w:tblW w:type="pct" w:w="2500"/>'}]}

    return _parts_of(spark, d, describe).column_widths(200.0).select("doc_id", "column", F.round("width", 6).alias("width"))


@query("""SELECT p_partkey, p_size * 1.4 * CASE p_size % 3 WHEN 2 THEN 1.5 ELSE 1 END AS natural, CASE p_size % 4 WHEN 0 THEN p_size * 36.0 WHEN 1 THEN p_size / 2.0 WHEN 2 THEN p_size::DOUBLE ELSE 0.0 END::DOUBLE AS measure,
CASE WHEN p_size % 2 = 0 THEN p_size * 16 + 10 END::BIGINT AS ident FROM part""")
def scalar_measures(spark, d):
    n = F.col("p_size")
    rule = n % 3
    spacing = F.when(rule == 2, 18.0).when(rule == 0, 1.0).otherwise(n * 1.4)
    raw = F.when(n % 4 == 0, F.concat(n / 2, F.lit("in"))).when(n % 4 == 1, F.concat(n, F.lit(" hp"))).when(n % 4 == 2, n.cast("string")).otherwise("none")
    ident = F.when(n % 2 == 0, F.concat(F.lit(" 000000000"), F.hex(n * 16 + 10))).otherwise(F.concat(F.lit("x"), n))
    return _table(spark, d, "part").select("p_partkey", F.round(S.line_height(n.cast("double"), spacing, rule), 9).alias("natural"), F.round(S.universal_measure(raw, "pt"), 9).alias("measure"), S.hexadecimal_id(ident).alias("ident"))


ORACLES["scalar_measures"] = ORACLES["scalar_measures"].replace("p_size * 1.4 * CASE p_size % 3 WHEN 2 THEN 1.5 ELSE 1 END AS natural", "round((p_size * 1.4 * CASE p_size % 3 WHEN 2 THEN 1.5 ELSE 1 END)::DOUBLE, 9) AS natural")


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 100 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE -2147483648 END::BIGINT AS note_id FROM part")
def note_id_forms(spark, d):
    n = F.col("p_size")
    raw = F.when(n % 5 == 0, F.concat(F.lit(" "), n, F.lit(".75\n"))).when(n % 5 == 1, F.concat(n, F.lit("e2"))).when(n % 5 == 2, F.lit("9999999999999999999999")).when(n % 5 == 3, F.concat(n, F.lit("x"))).otherwise("2147483648")
    return _table(spark, d, "part").select("p_partkey", S.note_id(raw).alias("note_id"))


@query(f"SELECT doc_id, CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS replaced, n % 2 = 0 AS refused, CASE WHEN n % 3 = 0 THEN 'absent' END AS missing FROM ({_N})")
def signed_documents(spark, d):
    def describe(n):
        return {"blocks": [{"runs": [{"t": "old"}, {"t": "" if n % 3 == 0 else "absent"}]}], "other_parts": {"_xmlsignatures/sig1.xml": b"<s/>"} if n % 2 == 0 else {}}

    parts = _parts_of(spark, d, describe).keep_parts().parts
    out = edit.replace_text(parts, {"old": "new"}).groupBy("doc_id").agg(F.sum("replaced").alias("replaced"), F.max(F.col("load_error").isNotNull()).alias("refused"))
    return out.join(edit.missing_words(parts, ["old", "absent"]).select("doc_id", F.col("word").alias("missing")), "doc_id", "left")


@query(f"""WITH c AS (SELECT doc_id, n, r, k FROM ({_N}), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(2)) AS k)),
s AS (SELECT *, unnest(['top', 'bottom', 'left', 'right']) AS side FROM c),
o AS (SELECT *, CASE side WHEN 'top' THEN r = 0 WHEN 'bottom' THEN r = 1 WHEN 'left' THEN k = 0 ELSE k = 1 END AS rim FROM s)
SELECT doc_id, r::INT AS "row", k::INT AS cell, side, CASE WHEN r = 0 AND k = 0 AND side = 'top' AND n % 2 = 0 THEN 6
WHEN n % 3 = 0 THEN CASE WHEN rim AND side = 'top' THEN 2 END WHEN n % 3 = 1 THEN CASE WHEN NOT rim AND side IN ('left', 'right') THEN 1 END END::INT AS line_style FROM o""")
def border_conflict(spark, d):
    def describe(n):
        styles = [{"id": "Base", "name": "Base", "kind": "table", "more": '<w:tblPr><w:tblBorders><w:insideV w:val="single" w:sz="4"/></w:tblBorders></w:tblPr>'}, {"id": "T", "name": "T", "kind": "table", "base": "Base"}]
        own = {0: '<w:tblStyle w:val="T"/><w:tblBorders><w:top w:val="thick" w:sz="8"/><w:insideV w:val="none"/></w:tblBorders>', 1: '<w:tblStyle w:val="T"/>', 2: ""}[n % 3]
        first = {"t": "x", "tcpr": '<w:tcBorders><w:top w:val="dotted" w:sz="4"/><w:left w:val="nil"/></w:tcBorders>' if n % 2 == 0 else ""}
        return {"styles": styles, "blocks": [{"table": [[first, {"t": "x"}], [{"t": "x"}, {"t": "x"}]], "tblpr": own}]}

    b = _parts_of(spark, d, describe).cell_borders()
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.line_style").alias("line_style")) for s in properties.SIDES])
    return b.select("doc_id", "row", "cell", F.inline(sides))


@query(f"SELECT doc_id, ceil((n * 3) / {pdf.LINES}.0)::BIGINT AS pages FROM ({_N})")
def pdf_line_pages(spark, d):
    c = _parts_of(spark, d, lambda n: {"blocks": [{"runs": [{"t": f"line {k}"}]} for k in range(n * 3)]})
    texts = c.paragraph_texts().select("doc_id", F.col("block_path").alias("path"), "text", F.lit(None).cast("int").alias("heading_level"))
    return pdf.to_pdf(texts).select("doc_id", "pages")


@query()
def pdf_pages(spark, d):
    c = _corpus(_texts(spark, d), _plain)
    texts = c.paragraph_texts().select("doc_id", F.col("block_path").alias("path"), "text", F.lit(None).cast("int").alias("heading_level"))
    return pdf.to_pdf(texts).select("doc_id", "pages", F.octet_length("pdf").alias("bytes"))

