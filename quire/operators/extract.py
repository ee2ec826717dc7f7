"""Text, outlines, structured export and diagnostics of a corpus of packages."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import annotations, cascade, properties, resolve
from ..sources import package, shred
from ..store import bucketed, written


class Corpus:
    """Packages (doc_id, content) and the node tables shredded from them.

    Node tables are made by passes over the packages, each of which runs a job and keeps its tables in the shared folder,
    in a folder of their own. ``shred`` makes such a pass for the tables named; a method that needs tables which are
    not there yet does so for those it needs, and a table used as an attribute for all that are missing. The parts with
    their bytes are read from the packages when asked for.
    """

    def __init__(self, packages: DataFrame, permissive: bool = True, dealt: int | None = None):
        """dealt: the number of partitions if the packages are dealt to them by doc_id; their node tables stay so."""
        self.packages, self.permissive, self.dealt = packages, permissive, dealt
        self._stored: dict[str, DataFrame] = {}

    @cached_property
    def parts(self) -> DataFrame:
        return package.parts(self.packages, self.permissive)

    def keep_parts(self) -> Corpus:
        """Stores the parts, so that plans which read them more than once open the packages once; this runs a job."""
        self.__dict__["parts"] = written(self.parts, "parts")
        return self

    def recoded(self, kind: str) -> Corpus:
        """The packages in the form kind, docx or flat_opc."""
        return Corpus(package.recoded(self.packages, kind, self.permissive), self.permissive, self.dealt)

    def shred(self, *names: str) -> Corpus:
        """Makes the node tables named, or all but those that are made only when named, if they are not there yet, in one
        pass; this runs a job."""
        missing = tuple(n for n in shred.TABLES if (n in names if names else n not in shred.ON_DEMAND) and n not in self._stored)
        if missing:
            nodes = shred.everything(self.packages, missing)
            nodes = bucketed(nodes, "nodes", "doc_id", self.dealt, by=["node"]) if self.dealt else written(nodes, "nodes", by=["node"])
            # every table has rows of every document, and equal ones pack so well that files of a few MB hold millions: none is broadcast
            self._stored |= {n: nodes.filter(F.col("node") == n).select("doc_id", f"{n}.*").hint("merge") for n in missing}
        return self

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """df, rows of documents, stored in the buckets of the packages if they are dealt to any; this runs a job. A task holds a
        page of memory for each sort of its stage, whatever its rows, so that plans of very many joins are made in steps."""
        if not self.dealt:
            return written(df, name).hint("merge")
        return bucketed(df.repartition(self.dealt, "doc_id"), name, "doc_id", self.dealt, by=[]).hint("merge")

    def node(self, name: str) -> DataFrame:
        """One of the tables of shred.TABLES."""
        if name not in shred.TABLES:
            raise KeyError(name)
        if name not in self._stored:
            self.shred(*([name] if name in shred.ON_DEMAND else []))
        return self._stored[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in shred.TABLES:
            return self.node(name)
        raise AttributeError(name)

    @property
    def main(self) -> DataFrame:
        """Runs and marks of the main story."""
        return self.inlines.filter("role = 'main'")

    def shown_runs(self, inlines: DataFrame | None = None) -> DataFrame:
        """Runs outside field codes with capitals applied; ``vanish`` and ``left_out`` say whether they are hidden, through
        all styles. Of the main story unless others are given."""
        self.shred("inlines", "styles")
        return cascade.shown_text(resolve.visible(self.main if inlines is None else inlines), cascade.text_context(self.styles))

    def paragraph_texts(self) -> DataFrame:
        """(doc_id, block_path, text): visible text of paragraphs, capitals applied, hidden runs left out."""
        joined = self.shown_runs().filter(~F.col("left_out")).groupBy("doc_id", "block_path").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("runs"))
        return joined.select("doc_id", "block_path", F.array_join("runs.text", "").alias("text"))

    def text(self, blank: bool = False) -> DataFrame:
        """(doc_id, text): non-empty paragraphs in order, those of cells too, one a line; empty for a package without any.
        With ``blank`` empty paragraphs are lines too."""
        self.shred("inlines", "styles", "loaded", *(["blocks"] if blank else []))
        texts = self.paragraph_texts().filter(F.col("text") != "")
        if blank:
            every = self.blocks.filter("node_type = 'Paragraph'").select("doc_id", F.col("path").alias("block_path"))
            texts = every.join(texts, ["doc_id", "block_path"], "left").withColumn("text", F.coalesce("text", F.lit("")))
        listed = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_path", "text"))).alias("p"))
        return self.loaded.select("doc_id").join(listed, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("p.text", "\n"), F.lit("")).alias("text"))

    def dom_text(self) -> DataFrame:
        """(doc_id, text) in the alphabet of the editing model: a paragraph ends with \\r, the last of a section with
        \\x0c, of a cell with \\x07, and so does a row; breaks are \\x0b, \\x0c and \\x0e, fields \\x13, \\x14 and \\x15, notes
        \\x02 and comments \\x05. Field codes and hidden runs are kept.
        """
        self.shred("inlines", "blocks", "cells")
        # The characters of marks, and of the breaks that runs hold as \n, \f and \v.
        marks = {"FieldStart": "\x13", "FieldSeparator": "\x14", "FieldEnd": "\x15", "NoteReference": "\x02", "CommentMarker": "\x05"}
        shown = F.when(F.col("kind") == "Run", F.translate("text", "\n\f\v", "\x0b\x0c\x0e"))
        for kind, mark in marks.items():
            shown = shown.when(F.col("kind") == kind, F.lit(mark))
        texts = self.main.groupBy("doc_id", "block_path").agg(F.sort_array(F.collect_list(F.struct("ord", shown.alias("t")))).alias("r"))
        texts = texts.select("doc_id", F.col("block_path").alias("path"), F.array_join("r.t", "").alias("text"))
        w = Window.partitionBy("doc_id", F.slice("path", 1, F.size("path") - 1))
        last = F.max("path").over(w) == F.col("path")
        end = F.when(F.size("path") > 1, F.when(last, "\x07").otherwise("\r")).otherwise(F.when(F.col("ends_section") | last, "\x0c").otherwise("\r"))
        paragraphs = self.blocks.withColumn("end", end).filter("node_type = 'Paragraph'").join(texts, ["doc_id", "path"], "left")
        paragraphs = paragraphs.select("doc_id", "path", F.concat(F.coalesce("text", F.lit("")), "end").alias("t"))
        rows = self.cells.select("doc_id", F.concat("table_path", F.array("row", F.lit(1 << 30))).alias("path"), F.lit("\x07").alias("t")).distinct()
        listed = paragraphs.union(rows).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("path", "t"))).alias("f"))
        return listed.select("doc_id", F.array_join("f.t", "").alias("text"))

    def headings(self) -> DataFrame:
        """(doc_id, path, heading_level, depth, text) of headings at body level."""
        self.shred("inlines", "blocks", "styles")
        h = resolve.outline(resolve.headings(self.blocks, self.styles))
        texts = self.paragraph_texts().withColumnRenamed("block_path", "path")
        return h.join(texts, ["doc_id", "path"], "left").select("doc_id", "path", "heading_level", "depth", F.coalesce("text", F.lit("")).alias("text"))

    def labels(self) -> DataFrame:
        """(doc_id, path, list_id, level, label, uncounted) of list items; uncounted are the levels that a label shows though
        none of their items came before."""
        self.shred("blocks", "styles", "list_levels")
        levels = self.list_levels.select("doc_id", "list_id", "level", "number_style", "number_format", "start_at")
        return resolve.list_labels(resolve.list_references(self.blocks, self.styles), levels)

    def paragraph_formats(self) -> DataFrame:
        """Paragraphs of the main story with what they, their styles, their table's style and the defaults declare."""
        self.shred("blocks", "properties", "styles")
        return cascade.paragraph_formats(self.blocks, self.properties, self.styles)

    def cell_fonts(self, counting: str = "cells") -> DataFrame:
        """Cells with the font of their table's style; counting is ``cells`` or ``size`` for the properties, ``grid`` for what is painted."""
        self.shred("cells", "blocks", "properties", "theme_slots", "styles")
        return cascade.cell_fonts(self.cells, self.blocks, self.properties, self.theme_slots, self.styles, counting, keep=self.settled)

    def cell_paragraph_formats(self, counting: str = "cells") -> DataFrame:
        """Cells with the paragraph format of their table's style."""
        self.shred("cells", "blocks", "properties", "styles")
        return cascade.cell_paragraph_formats(self.cells, self.blocks, self.properties, self.styles, counting)

    def cell_borders(self) -> DataFrame:
        """Cells with the borders that their four sides show."""
        self.shred("cells", "properties", "styles")
        return properties.cell_borders(self.cells, self.properties, self.styles)

    def column_widths(self, usable: float) -> DataFrame:
        """Columns of the tables' grids with their width in points, in tables of at most ``usable`` points."""
        self.shred("cells", "properties")
        return properties.column_widths(properties.table_formats(self.properties), self.cells, properties.cell_formats(self.properties), usable)

    def cell_texts(self) -> DataFrame:
        """(doc_id, table_path, row, cell, text): the paragraphs of a cell that hold text, one a line; nested tables are left out."""
        self.shred("inlines", "styles", "cells")
        n = F.size("block_path")
        t = self.paragraph_texts().filter((n >= 4) & (F.col("text") != ""))
        t = t.select("doc_id", F.slice("block_path", F.lit(1), n - 3).alias("table_path"), F.element_at("block_path", n - 2).alias("row"), F.element_at("block_path", n - 1).alias("cell"), F.col("block_path"), "text")
        own = t.groupBy("doc_id", "table_path", "row", "cell").agg(F.sort_array(F.collect_list(F.struct("block_path", "text"))).alias("l"))
        return self.cells.join(own, ["doc_id", "table_path", "row", "cell"], "left").select("doc_id", "table_path", "row", "cell", "grid_span", "horizontal_merge", "vertical_merge", F.coalesce(F.array_join("l.text", "\n"), F.lit("")).alias("text"))

    def links(self) -> DataFrame:
        """(doc_id, part_name, block_path, ord, text, url) of the runs of links."""
        self.shred("inlines", "relationships")
        return resolve.links(resolve.visible(self.inlines), self.relationships)

    def fonts(self, *columns: str) -> DataFrame:
        """Runs of the main story with their font properties, all unless some are named, through every layer; see cascade.run_fonts."""
        self.shred("inlines", "cells", "blocks", "properties", "theme_slots", "styles")
        wanted = columns or cascade.EVERY
        # a corpus without any cell has no sizes of cells
        sizes = cascade.cell_sizes(self.cells, self.blocks, self.properties, self.theme_slots, self.styles, self.settled) if "size" in wanted and not self.cells.isEmpty() else None
        return cascade.run_fonts(self.main, self.properties, self.theme_slots, self.styles, sizes, wanted, self.settled)

    def node_elements(self, styles: bool = True) -> DataFrame:
        """Every element of the stories, and of the styles unless they are left out, with its interval and its bytes; see
        plans.tree and operators.splice."""
        if not styles:
            return self.shred("elements").elements
        self.shred("elements", "style_elements")
        return self.elements.unionByName(self.style_elements).hint("merge")

    def comment_dates(self, zone: str) -> DataFrame:
        """(doc_id, comment_id, date_utc, modern) of comments; dates without an offset of their own are of ``zone``."""
        self.shred("comment_paragraphs", "comment_records", "relationships")
        return annotations.comment_dates(self.comment_paragraphs, self.comment_records, self.relationships, zone)

    def annotation_faults(self) -> DataFrame:
        """(doc_id, identifier, fault): what is wrong with comments, their marks and replies."""
        self.shred("annotation_marks", "stories", "threads")
        return annotations.comment_faults(self.annotation_marks, self.stories, self.threads)

    def export(self) -> DataFrame:
        """(doc_id, json): blocks of the body in order with location, type, text, style, heading level, list, runs with their
        links, note references and images; of tables the rows of cells with their merges, text and paragraphs; then headers
        and footers of each section, and notes and comments with their blocks and how often they are referred to."""
        # all passes over the packages that this needs are one
        self.shred("inlines", "cells", "blocks", "properties", "theme_slots", "styles", "drawings", "relationships", "section_references", "story_blocks", "story_inlines")
        keys = ["doc_id", "block_path", "ord"]
        urls = resolve.links(resolve.visible(self.main), self.relationships).select(*keys, F.col("url").alias("link"))
        shown = resolve.visible(self.main).select(*keys)
        fonts = self.fonts("b", "i", "caps", "smallCaps", "size").join(shown, keys, "left_semi").filter(~F.coalesce("vanish", F.lit(False))).join(urls, keys, "left")
        run = F.struct("ord", S.apply_caps(F.col("text"), F.col("caps") | F.col("smallCaps")).alias("text"), "link", F.col("b").alias("bold"), F.col("i").alias("italic"), "size")
        runs = fonts.groupBy("doc_id", F.col("block_path").alias("path")).agg(F.sort_array(F.collect_list(run)).alias("r"))
        runs = runs.select("doc_id", "path", F.transform("r", lambda x: x.dropFields("ord")).alias("runs"), F.array_join("r.text", "").alias("text"))
        runs = self.settled(runs, "runs")
        marks = self.main.filter("kind = 'NoteReference'").groupBy("doc_id", F.col("block_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("text").alias("kind"), F.col("ident").alias("identifier")))).alias("n"))
        marks = marks.select("doc_id", "path", F.transform("n", lambda x: F.struct(F.regexp_replace(x["kind"], "Reference$", "").alias("kind"), x["identifier"].alias("identifier"))).alias("note_references"))
        images = self.drawings.filter("rid is not null").groupBy("doc_id", F.col("block_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ord", "alternative_text", F.col("width").alias("width_pt"), F.col("height").alias("height_pt")))).alias("images"))
        images = images.withColumn("images", F.transform("images", lambda x: x.dropFields("ord")))
        cell = F.struct("row", "cell", "grid_span", "horizontal_merge", "vertical_merge", "text", "blocks")
        inside = self._cell_blocks(runs)
        cells = self.settled(self.cell_texts(), "cell_texts").join(inside, ["doc_id", "table_path", "row", "cell"], "left")
        tables = cells.groupBy("doc_id", F.col("table_path").alias("path")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        row_numbers = F.array_sort(F.array_distinct(F.col("cells.row")))
        tables = tables.select("doc_id", "path", F.transform(row_numbers, lambda n: F.struct(F.transform(F.filter("cells", lambda c: c["row"] == n), lambda c: c.dropFields("row", "cell")).alias("cells"))).alias("rows"))
        tables = self.settled(tables, "tables")
        levels = self.settled(resolve.headings(self.blocks, self.styles).select("doc_id", "path", "heading_level"), "levels")
        lists = self.settled(resolve.list_references(self.blocks, self.styles).select("doc_id", "path", F.col("list_id").alias("_list"), F.col("level").alias("_level")), "lists")
        top = resolve.sections(self.blocks)
        for part in (levels, runs, marks, images, tables, lists):
            top = top.join(part, ["doc_id", "path"], "left")
        first = F.min(F.element_at("path", 1)).over(Window.partitionBy("doc_id", "section"))
        top = top.withColumn("location", F.concat(F.lit("sections["), F.col("section"), F.lit("].body.children["), F.element_at("path", 1) - first, F.lit("]")))
        paragraph = F.col("node_type") == "Paragraph"
        block = F.struct(
            F.col("path"), F.lower("node_type").alias("type"), F.col("location"), F.when(paragraph, F.coalesce("text", F.lit(""))).alias("text"), F.when(paragraph, F.col("style_id")).alias("style"), F.col("heading_level"),
            F.struct(F.col("_list").isNotNull().alias("is_list_item"), F.col("_level").alias("list_level_number"), F.col("_list").alias("list_id")).alias("list"), F.col("runs"), F.col("note_references"), F.col("images"), F.col("rows"))
        listed = top.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("path", block.dropFields("path").alias("b")))).alias("blocks"))
        listed = self.settled(listed, "listed")
        headers, stories = (self.settled(df, name) for df, name in zip(self._exported_stories(), ("headers", "stories"), strict=True))
        full = listed.join(headers, "doc_id", "left").join(stories, "doc_id", "left")
        none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
        body = F.struct(F.lit(1).alias("schema_version"), F.col("blocks.b").alias("blocks"), none("headers_footers", headers), none("source_stories", stories))
        return full.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))

    def _cell_blocks(self, runs: DataFrame) -> DataFrame:
        """(doc_id, table_path, row, cell, blocks): the paragraphs of cells of tables in the body, with their runs; what is in
        tables inside them is with those."""
        n = F.size("path")
        p = self.blocks.filter((F.col("node_type") == "Paragraph") & (n >= 4)).join(runs, ["doc_id", "path"], "left")
        p = p.select("doc_id", F.slice("path", F.lit(1), n - 3).alias("table_path"), F.element_at("path", n - 2).alias("row"), F.element_at("path", n - 1).alias("cell"), F.struct(
            F.element_at("path", -1).alias("place"), F.lit("paragraph").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.col("style_id").alias("style"), F.lit(None).cast("int").alias("heading_level"), "runs").alias("b"))
        by = p.groupBy("doc_id", "table_path", "row", "cell").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
        return by.withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("place")))

    def story_texts(self) -> DataFrame:
        """Blocks at the top of headers, footers, notes and comments: doc_id, part_name, role, story_kind, story_id, note_type,
        story (its number in the part), place, type, style, text and runs; of a table the text of its paragraphs."""
        self.shred("inlines", "styles", "story_blocks", "story_inlines")
        runs = self.shown_runs(self.story_inlines).filter(~F.col("left_out"))
        one = F.struct("ord", "text")
        texts = runs.groupBy("doc_id", "part_name", "block_path").agg(F.sort_array(F.collect_list(one)).alias("runs"))
        texts = texts.select("doc_id", "part_name", F.col("block_path").alias("path"), F.transform("runs", lambda r: r["text"]).alias("runs"), F.array_join("runs.text", "").alias("text"))
        top = F.slice("path", F.lit(1), F.when(F.col("role").isin("header", "footer"), 1).otherwise(2))
        at = self.story_blocks.join(texts, ["doc_id", "part_name", "path"], "left").withColumn("top", top)
        keys = ("doc_id", "part_name", "role", "story_kind", "story_id", "note_type", "story", "top")
        by = at.groupBy(*keys).agg(
            F.min_by("node_type", "path").alias("type"), F.min_by("style_id", "path").alias("style"), F.min_by("runs", "path").alias("runs"),
            F.sort_array(F.collect_list(F.when(F.col("node_type") == "Paragraph", F.struct("path", F.coalesce("text", F.lit("")).alias("text"))))).alias("p"))
        inner = F.filter("p.text", lambda t: t != "")
        text = F.when(F.col("type") == "Table", F.array_join(inner, "\n")).otherwise(F.coalesce(F.get(F.col("p.text"), F.lit(0)), F.lit("")))
        return by.select(*[c for c in keys if c != "top"], F.element_at("top", -1).alias("place"), F.lower("type").alias("type"), "style", text.alias("text"), F.coalesce("runs", F.array().cast("array<string>")).alias("runs"))

    def _exported_stories(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, headers_footers) by section and kind, and (doc_id, source_stories) of notes and comments."""
        own = self.settled(self.story_texts(), "story_texts")
        block = F.struct("place", "type", "text", "style", "runs")
        lists = own.groupBy("doc_id", "part_name", "role", "story_kind", "story_id", "note_type", "story").agg(F.sort_array(F.collect_list(block)).alias("blocks")).withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("place")))
        shown = resolve.header_assignment(self.section_references, self.relationships)
        of = lists.filter(F.col("role").isin("header", "footer")).select("doc_id", F.col("part_name").alias("part"), "blocks")
        at = shown.filter("not inherited").join(of, ["doc_id", "part"])
        place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("kind", "variant")) - 1
        location = F.concat(F.lit("sections["), F.col("section"), F.lit("].headers_footers["), place, F.lit("]"))
        headers = at.select("doc_id", F.struct("section", "kind", "variant", location.alias("location"), "blocks").alias("h"))
        headers = headers.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("h")), lambda h: F.struct(h["location"].alias("location"), F.concat(h["kind"], F.lit(":"), h["variant"]).alias("type"), h["blocks"].alias("blocks"))).alias("headers_footers"))
        kind = F.when(F.col("kind") == "CommentMarker", "comment").otherwise(F.regexp_replace("text", "Reference$", ""))
        uses = self.main.filter(F.col("kind").isin("NoteReference", "CommentMarker")).groupBy("doc_id", kind.alias("story_kind"), F.col("ident").alias("story_id")).agg(F.count(F.lit(1)).cast("int").alias("references"))
        notes = lists.filter("story_kind is not null").join(uses, ["doc_id", "story_kind", "story_id"], "left")
        story = F.struct("part_name", "story", F.col("story_kind").alias("kind"), F.col("story_id").alias("identifier"), "note_type", F.coalesce("references", F.lit(0)).alias("references"), "blocks")
        stories = notes.groupBy("doc_id").agg(F.sort_array(F.collect_list(story)).alias("source_stories")).withColumn("source_stories", F.transform("source_stories", lambda x: x.dropFields("story")))
        return headers, stories

    def diagnostics(self) -> DataFrame:
        """(doc_id, code, severity, location, message): everything that reading lost or found wrong."""
        self.shred("load_errors", "inventory", "constructs", "inlines", "stories", "section_references", "relationships", "properties")
        row = lambda df, code, severity, location, message: df.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), location.cast("string").alias("location"), message.alias("message"))
        none = F.lit(None)
        found = [
            row(self.load_errors, "load_error", "error", none, F.col("message")),
            row(self.inventory.filter("not is_xml"), "invalid_xml", "error", F.col("part_name"), F.lit("a part is not well-formed")),
            row(self.constructs, "unsupported_construct", "warning", F.col("part_name"), F.concat("construct", F.lit(" x "), "uses")),
            row(resolve.anchor_faults(self.main, self.stories), "anchor_fault", "warning", F.concat("kind", F.lit(" "), "identifier"), F.col("fault")),
            row(self.inventory.filter(F.col("part_name").endswith("vbaProject.bin")), "vba_omitted", "warning", F.col("part_name"), F.lit("macros are left out")),
            row(resolve.header_assignment(self.section_references, self.relationships).join(self.inventory.select("doc_id", F.col("part_name").alias("part")), ["doc_id", "part"], "left_anti"), "missing_story", "warning", F.concat(F.lit("section "), "section"), F.concat_ws(" ", "kind", "variant")),
            row(self.properties.filter(F.exists(F.map_keys("props"), lambda k: k.rlike("^ind@[a-zA-Z]+Chars$"))), "character_indent", "warning", F.concat("part_name", F.lit(" "), "owner"), F.lit("an indent in characters is not laid out")),
            row(self.stories.groupBy("doc_id", "kind", "identifier").count().filter("count > 1"), "duplicate_story", "error", F.concat("kind", F.lit(" "), "identifier"), F.lit("an identifier is used more than once")),
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out
